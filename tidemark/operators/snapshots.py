"""Process features from memory snapshots: one grouped aggregation with many conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import top_k

# Fixed values of the snapshot format: handle types, page protections, tags, wait reasons, sentinels.
HANDLE_TYPES = [
    ("Directory", "directory"),
    ("TpWorkerFactory", "tpworkerfactory"),
    ("WaitCompletionPacket", "waitcompletionpacket"),
    ("Section", "section"),
    ("File", "file"),
    ("Mutant", "mutant"),
    ("Event", "event"),
    ("Semaphore", "semaphore"),
    ("Key", "key"),
    ("IoCompletion", "iocompletion"),
    ("ALPC Port", "alpc port"),
    ("Thread", "thread"),
]
RATIO_ONLY_TYPES = [
    ("IoCompletionReserve", "iocompletionreserve"),
    ("Desktop", "desktop"),
    ("EtwRegistration", "etwregistration"),
    ("WindowStation", "windowstation"),
]
READWRITE_EXEC = "PAGE_EXECUTE_READWRITE "
NO_ACCESS = "PAGE_NOACCESS "
WRITECOPY_EXEC = "PAGE_EXECUTE_WRITECOPY "
READ_ONLY = "PAGE_READONLY "
READ_WRITE = "PAGE_READWRITE "
VAD = "Vad "
VADS = "VadS"
WAIT_REASONS = ["9", "31", "13"]
FULL_MEMORY = 2147483647
PATH_EXTENSIONS = ".COM;.EXE;.BAT;.CMD;.VBS;.VBE;.JS;.JSE;.WSF;.WSH;.MSC;.CPL"


def double_extension(name: Column, extensions: Sequence[str]) -> Column:
    """Length of what follows a known extension in the middle of a file name, null when there is none."""
    parts = F.split(name, r"\.")
    known = F.array(*[F.lit(e) for e in extensions])
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    first = F.array_position(F.transform(inner, lambda p: F.array_contains(known, p)), True).cast("int")
    rest = F.array_join(F.slice(parts, first + 1, F.size(parts)), ".")
    return F.when((F.size(inner) > 1) & (first > 0), F.char_length(rest))


def snapshot_features(df: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """About a hundred features per (snapshot_id, pid_process); absent groups of rows leave zeros.

    ``df`` holds the rows of all plugins: snapshot_id, timestamp, plugin, PID, Process, CommitCharge, Name,
    Type, State, WaitReason, Tag, Protection, PrivateMemory, File, Variable, Value, Size, Path.
    """
    c = F.col
    df = _derived(df, extensions)
    vad, handle, thread, env, ldr = (c("plugin") == p for p in ("vadinfo", "handles", "threadlist", "envars", "ldrmodules"))
    charge, file_name, extension, folder = c("_charge"), c("_file"), c("_extension"), c("_folder")
    depth, tail = c("_depth"), c("_tail")
    deep = F.size(depth) > 3
    on_disk = deep & (F.size(depth) > 4) & (F.try_element_at(depth, F.lit(2)) == "device") & F.try_element_at(
        depth, F.lit(3)
    ).contains("harddisk")
    area = F.try_element_at(depth, F.lit(4))
    exec_path = env & c("Variable").contains("PATHEXT") & c("Value").contains(PATH_EXTENSIONS)
    module = ldr & c("Name").contains(F.lower(c("Process")))

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def when(condition: Column, value: Column = charge) -> Column:
        return F.when(condition, value)

    a: dict[str, Column] = {
        "envirs_pathext": F.max(exec_path.cast("int")),
        "envars_df_count": n(exec_path),
        "threadlist_df_count": n(thread),
        "threadlist_df_state_2": n(thread & (c("State") == "2")),
    }
    for reason in WAIT_REASONS:
        a[f"threadlist_df_wait_reason_{reason}"] = n(thread & (c("WaitReason") == reason))
    is_vad, is_vads = vad & (c("Tag") == VAD), vad & (c("Tag") == VADS)
    a.update(
        {
            "_rows": n(vad),
            "vad_count": n(is_vad),
            "vads_count": n(is_vads),
            "count_private_memory": n(vad & (c("PrivateMemory") == "1")),
            "get_commit_charge_mean": F.avg(when(vad)),
            "get_commit_charge_max": F.max(when(vad)),
            "get_commit_charge_sum": F.sum(when(vad)),
            "get_commit_charge_len": F.count(when(vad)),
            "get_commit_charge_mean_vad": F.avg(when(is_vad)),
            "get_commit_charge_max_vad": F.max(when(is_vad)),
            "get_commit_charge_sum_vad": F.sum(when(is_vad)),
            "get_commit_charge_min_vads": F.min(when(is_vads)),
            "count_entire_commit_charge_vads": n(is_vads & (c("CommitCharge") == FULL_MEMORY)),
            "get_commit_charge_min_vad_page_noaccess": F.min(when(is_vad & (c("Protection") == NO_ACCESS))),
            "get_commit_charge_mean_vad_page_noaccess": F.avg(when(is_vad & (c("Protection") == NO_ACCESS))),
        }
    )
    stats = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}
    wanted = [
        (READWRITE_EXEC, "page_execute_readwrite", ["mean", "min", "max", "sum", "std"]),
        (NO_ACCESS, "page_no_access", ["mean", "min", "max", "sum"]),
        (WRITECOPY_EXEC, "page_execute_writecopy", ["min", "sum"]),
        (READ_ONLY, "page_readonly", ["mean"]),
        (READ_WRITE, "page_readwrite", []),
    ]
    for protection, label, kinds in wanted:
        rows = vad & (c("Protection") == protection)
        for kind in kinds:
            a[f"get_commit_charge_{kind}_{label}"] = stats[kind](when(rows))
        a[f"_{label}"] = n(rows)
        a[f"_{label}_vads"] = n(rows & (c("Tag") == VADS))
        a[f"_{label}_vad"] = n(rows & (c("Tag") == VAD))
    a.update(
        {
            "count_double_extension_count_handles": F.count(tail),
            "double_extension_len_handles": F.max(tail),
            "check_doc_file_handle_count": n(extension.isin(*extensions)),
            "_deep": n(deep),
            "_no_folder": F.max((file_name.isNotNull() & folder.isNull()).cast("int")),
            "_users": n(on_disk & area.contains("users")),
            "_windows": n(on_disk & area.contains("windows")),
            "handles_df_count": n(handle),
        }
    )
    for kind, label in HANDLE_TYPES + RATIO_ONLY_TYPES:
        a[f"_type_{label}"] = n(handle & (c("Type") == kind))
    vad_extension = F.nullif(F.regexp_extract(F.lower(c("File")), r"(\.[^.]*)$", 1), F.lit(""))
    uniques = {
        "threadlist_df_state_unique": when(thread, F.coalesce(c("State"), F.lit("nan"))),
        "threadlist_df_wait_reason_unique": when(thread, F.coalesce(c("WaitReason"), F.lit("nan"))),
        "get_count_unique_extensions": when(vad & (c("File") != "N/A"), vad_extension),
        "vadinfo_df_path_unique": when(vad, F.coalesce(c("File"), F.lit("nan"))),
        "_folders": folder,
        "count_extension_handles_uniques": extension,
        "handles_df_name_unique": when(handle, F.coalesce(c("Name"), F.lit("nan"))),
        "handles_df_type_unique": when(handle, F.coalesce(c("Type"), F.lit("nan"))),
    }
    keys = ["snapshot_id", "pid_process"]
    # Counters are one hash aggregate; the few text values come from the module rows alone, one row each.
    grouped = df.groupBy(*keys).agg(*[column.alias(key) for key, column in a.items()])
    first = top_k(df.filter(ldr).select(*keys, "timestamp"), keys, 1, F.asc_nulls_last("timestamp"), rank="_rank")
    modules = df.filter(module & c("row_id").isNotNull())
    modules = modules.select(*keys, "row_id", F.struct(c("Size").alias("size"), c("Path").alias("path")).alias("_module"))
    modules = top_k(modules, keys, 1, F.asc("row_id"), rank="_rank").drop("row_id", "_rank")
    grouped = grouped.join(first.drop("_rank"), keys, "left").join(modules, keys, "left")
    return _finish(grouped.join(_distinct_counts(df, keys, uniques), keys, "left").na.fill(0, list(uniques)))


def _derived(df: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Parsed columns in their own projection, so each is computed once per row."""
    name = F.lower("Name")
    is_file = (F.col("plugin") == "handles") & (F.col("Type") == "File") & name.isNotNull() & (name != "")
    out = df.withColumns(
        {
            "pid_process": F.concat_ws("_", F.col("PID").cast("string"), F.col("Process")),
            "_charge": F.when(F.col("CommitCharge") < FULL_MEMORY, F.col("CommitCharge").cast("double")),
            "_file": F.when(is_file, name),
        }
    )
    file_name = F.col("_file")
    return out.withColumns(
        {
            "_extension": F.nullif(F.regexp_extract(file_name, r"\.([^.]*)$", 1), F.lit("")),
            "_folder": F.nullif(F.regexp_extract(file_name, r"^(.*)\\.*", 1), F.lit("")),
            "_depth": F.split(file_name, r"\\"),
            "_tail": double_extension(file_name, extensions),
        }
    )


def _distinct_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Distinct non-null values per key and column. A row yields only the values it has, where several
    count_distinct in one aggregation would copy every row once per column."""
    present = F.array_compact(
        F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("kind"), v.alias("value"))) for n, v in columns.items()])
    )
    seen = df.select(*keys, F.explode(present).alias("_u")).select(*keys, "_u.kind", "_u.value").distinct()
    return seen.groupBy(*keys).agg(*[F.count_if(F.col("kind") == n).alias(n) for n in columns])


def _ratio(top: str, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(F.col(top), bottom), F.lit(0.0))


def _finish(df: DataFrame) -> DataFrame:
    c = F.col
    handles = c("handles_df_count") + 1
    many = c("_deep") > 3
    out = {
        "ratio_private_memory": _ratio("count_private_memory", c("_rows")),
        "vad_ratio": _ratio("vad_count", c("_rows")),
        "page_execute_readwrite_count": c("_page_execute_readwrite"),
        "page_execute_readwrite_ratio": _ratio("_page_execute_readwrite", c("_rows")),
        "page_execute_readwrite_vads_count": c("_page_execute_readwrite_vads"),
        "page_execute_readwrite_vads_ratio": _ratio("_page_execute_readwrite_vads", c("vads_count")),
        "page_no_access_count": c("_page_no_access"),
        "page_no_access_ratio": _ratio("_page_no_access", c("_rows")),
        "page_execute_writecopy_vad_count": c("_page_execute_writecopy_vad"),
        "page_execute_writecopy_vad_ratio": _ratio("_page_execute_writecopy_vad", c("vad_count")),
        "page_readonly_count": c("_page_readonly"),
        "page_readonly_ratio": _ratio("_page_readonly", c("_rows")),
        "page_readwrite_ratio": _ratio("_page_readwrite", c("_rows")),
        "vads_page_execute_writecopy_ratio": c("vads_count") / (c("_page_execute_writecopy") + 1),
        "count_directories_handles_uniques": F.when(c("_deep") > 0, c("_folders") + c("_no_folder")).otherwise(0),
        "file_users_exists": F.when(many, c("_users")).otherwise(0),
        "file_windows_count": F.when(many, c("_windows")).otherwise(0),
        "handles_df_name_unique_ratio": c("handles_df_name_unique") / handles,
        "handles_df_type_unique_ratio": c("handles_df_type_unique") / handles,
        "ldrmodules_df_size_int": F.coalesce(
            F.conv(F.regexp_replace("_module.size", "^0x", ""), 16, 10).try_cast("bigint"), F.lit(0)
        ),
        "ldrmodules_df_path": F.coalesce(c("_module.path"), F.lit("")),
    }
    for label in ("page_no_access", "page_readonly", "page_readwrite"):
        for tag, total in (("vads", "vads_count"), ("vad", "vad_count")):
            out[f"{label}_{tag}_count"] = c(f"_{label}_{tag}")
            out[f"{label}_{tag}_ratio"] = _ratio(f"_{label}_{tag}", c(total))
    for _, label in HANDLE_TYPES:
        out[f"handles_df_{label}_count"] = c(f"_type_{label}")
    for _, label in HANDLE_TYPES + RATIO_ONLY_TYPES:
        out[f"handles_df_{label}_ratio"] = c(f"_type_{label}") / handles
    kept = [x for x in df.columns if not x.startswith("_")]
    return df.select(*[c(f"`{x}`") for x in kept], *[v.alias(k) for k, v in out.items()]).na.fill(0)
