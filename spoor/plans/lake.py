"""Lake zones: raw batches by ship date, normalised tables by event date."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import schema as S
from spoor import session
from spoor.functions import clock
from spoor.functions.text import sha_prefix
from spoor.operators import attribution, governance, runs
from spoor.operators.skew import rebalance
from spoor.sources import claude, codex, normalised, raw
from spoor.workspace import Workspace

MAX_ROWS_PER_FILE = 5_000_000


# ---- normalised zone ----------------------------------------------------------

def with_event_date(traces: DataFrame, time_zone: str = "UTC", modified_at: Column | None = None) -> DataFrame:
    """Adds the date a row is filed under: its own, in UTC or in a local zone, else
    the date its source was modified."""
    own = F.to_date(F.from_utc_timestamp("ts", time_zone) if time_zone != "UTC" else F.col("ts"))
    fallback = F.coalesce(F.to_date(modified_at), F.current_date()) if modified_at is not None else F.current_date()
    return traces.withColumn("event_date", F.coalesce(own, fallback))


def write_traces(traces: DataFrame, path: str, mode: str = "append", whole: bool = False) -> None:
    """Parquet by (event_date, agent). Rows are clustered by those, hot dates split
    over tasks, and sorted by session so that file statistics prune by session. Overwriting replaces the partitions that
    have rows, or, if ``whole``, all."""
    (
        rebalance(traces, "event_date", "agent").sortWithinPartitions("event_date", "agent", "session_id", "ts")
        .write.mode(mode).option("partitionOverwriteMode", "static" if whole else "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("event_date", "agent").parquet(path)
    )


def write_git(git: DataFrame, path: str, mode: str = "append", whole: bool = False) -> None:
    """Parquet by (event_date, repo_hash); the date is the author's calendar day."""
    rows = git.withColumn("event_date", F.substring("timestamp_text", 1, 10).try_cast("date")).withColumn(
        "repo_hash", governance.partition_hash(F.coalesce("repo", F.lit(""))))
    (
        rebalance(rows, "event_date", "repo_hash").sortWithinPartitions("event_date", "repo_hash", "ts")
        .write.mode(mode).option("partitionOverwriteMode", "static" if whole else "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("event_date", "repo_hash").parquet(path)
    )


def write_jsonl(traces: DataFrame, path: str) -> None:
    """The normalised text layout: ``{event_date}/{agent}`` files of JSON lines."""
    rebalance(traces, "event_date", "agent").write.mode("append").partitionBy("event_date", "agent").json(path)


def _read_dated(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table by event date; the schema is given, so that one without rows reads as such."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])).parquet(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return _read_dated(spark, path, S.TRACES)


def read_git(spark: SparkSession, path: str, linked: bool = False) -> DataFrame:
    """The commit table; ``linked`` adds how the load linked a commit, and its partition."""
    if not linked:
        return _read_dated(spark, path, S.GIT_EVENTS)
    return _read_dated(spark, path, T.StructType([*S.GIT_EVENTS.fields, *[T.StructField(c, T.StringType()) for c in ("linked_by", "repo_hash")]]))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return _read_dated(spark, path, S.FINDINGS)


def workspace(spark: SparkSession, out: str, **kw) -> Workspace:
    """The tables that ``build_tables`` wrote."""
    from spoor.plans import derived

    totals = derived.totals(spark, out)
    small = {
        "tool_agents": totals.where("kind = 'tool'").select(F.col("name").alias("tool_name"), "agent", "n"),
        "pattern_agents": totals.where("kind = 'pattern'").select(F.col("name").alias("pattern_type"), "agent"),
        "session_patterns": derived.read(spark, out, "session_patterns").select("session_id", "pattern_type").distinct(),
    }
    return Workspace(traces=read_traces(spark, f"{out}/traces"), git=read_git(spark, f"{out}/git_events"),
                     findings=read_findings(spark, f"{out}/findings"), **small, **kw)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.delete(at, True)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, at = _at(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(at) or []]


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole versions of a small table, oldest first."""
    return sorted(p.rsplit("/", 1)[0] for p in glob(spark, f"{path}/v*/_SUCCESS"))


def write_version(rows: DataFrame, path: str, tag: str = "") -> None:
    """A small table anew, as the version after the latest. Readers of that one can go on;
    older versions go."""
    spark = rows.sparkSession
    done = versions(spark, path)
    number = int(done[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if done else 0
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number:010d}-{tag or uuid.uuid4().hex}")
    for old in done[:-1]:
        delete(spark, old)


def partition_path(**values) -> str:
    """The folder of a partition, as Spark spells it."""
    escape = _escape_path_name()
    return "/".join(f"{k}=" + ("__HIVE_DEFAULT_PARTITION__" if v in (None, "") else escape(str(v))) for k, v in values.items())


def _escape_path_name():
    from pyspark import SparkContext

    return SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName


def any_of(conditions: list[Column]) -> Column:
    """Whether any holds. Halved again and again, so that many do not nest deeply."""
    if not conditions:
        return F.lit(False)
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return any_of(conditions[:half]) | any_of(conditions[half:])


def in_units(units: list[str], values: list[tuple]) -> Column:
    """Rows of the partitions with ``values`` of their two columns ``units``; Spark prunes the
    scan by it."""
    seconds: dict = {}
    for first, second in values:
        seconds.setdefault(first, []).append(second)

    def some(of: list) -> Column:
        held = [v for v in of if v is not None]
        return any_of(([F.col(units[1]).isin(held)] if held else []) + ([F.col(units[1]).isNull()] if len(held) < len(of) else []))

    return any_of([F.col(units[0]).eqNullSafe(F.lit(first)) & some(of) for first, of in seconds.items()])


# ---- raw zone -----------------------------------------------------------------

def with_batch_ids(batches: DataFrame) -> DataFrame:
    """Batches without an id get one from their content."""
    made = sha_prefix(16, F.col("developer"), F.coalesce("shippedAt", F.lit("")),
                                 F.sha2(F.to_json("entries"), 256))
    return batches.withColumn("batchId", F.coalesce("batchId", made))


def with_ship_partition(batches: DataFrame) -> DataFrame:
    at = F.coalesce(clock.parse_ts(F.col("shippedAt")), clock.parse_ts(F.col("receivedAt")))
    return batches.withColumns({
        "year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd"),
        "dev": governance.partition_hash(F.col("developer")),
    })


def new_batches(batches: DataFrame, landed: DataFrame | None) -> DataFrame:
    """Batches not seen before. Ids count per developer; of equal ids in one
    delivery one stays. Of ``landed`` only ids are read."""
    fresh = with_batch_ids(batches).dropDuplicates(["developer", "batchId"])
    if landed is None:
        return fresh
    return fresh.join(landed.select("developer", "batchId"), ["developer", "batchId"], "left_anti")


IDS = "developer string, batchId string"


def landed_ids(batches: DataFrame, path: str) -> DataFrame | None:
    """The ids landed for the developers of ``batches`` (with their ship partitions): those of
    the id table, by developer, and those in the very partitions the batches go to, which a
    landing that broke off may have filled before its ids were noted. Only these folders
    are listed."""
    spark = batches.sparkSession
    parts = batches.select("year", "month", "day", "agent", "dev").distinct().collect()
    folders = [f for f in sorted({f"{path}_ids/{partition_path(dev=r.dev)}" for r in parts}) if exists(spark, f)]
    own = [f for f in sorted({f"{path}/{partition_path(**r.asDict())}" for r in parts}) if exists(spark, f)]
    out = None
    for some in (folders, own):
        if some:
            ids = spark.read.schema(IDS).parquet(*some)
            out = ids if out is None else out.union(ids)
    return out


def note_ids(batches: DataFrame, path: str) -> None:
    """Add the ids of landed batches to the id table, by developer."""
    batches.select("developer", "batchId", "dev").repartition("dev").write.mode("append").partitionBy("dev").parquet(f"{path}_ids")


def land_batches(batches: DataFrame, path: str) -> None:
    """Append whole batches, one row each, by ship date, agent and developer hash."""
    (
        rebalance(with_ship_partition(batches), "year", "month", "day", "agent", "dev")
        .write.mode("append").partitionBy("year", "month", "day", "agent", "dev").parquet(path)
    )


def batch_schema() -> T.StructType:
    schema = T.StructType(list(S.BATCH.fields))
    for name in ("year", "month", "day", "dev"):
        schema = schema.add(name, "string")
    return schema


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(batch_schema()).parquet(path)


def catalogue(batches: DataFrame) -> DataFrame:
    """What arrived: one row per batch without its entries."""
    return batches.select(*[c for c in batches.columns if c != "entries"], F.size("entries").alias("entryCount"))


def read_batch_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """Metadata sidecars (pretty-printed JSON); broken ones drop out."""
    from spoor.functions import json as J

    v = F.col("v")
    docs = spark.read.text(glob, wholetext=True).where(J.is_object_text(F.col("value"))).select(J.parse(F.col("value")).alias("v")).where(v.isNotNull())
    names = ["batchId", "developer", "machine", "agent", "project", "shippedAt", "receivedAt", "filePath"]
    return docs.select(*[J.text(v, f"$.{n}").alias(n) for n in names], J.integer(v, "$.entryCount").alias("entryCount"))


PARSERS = {"claude_code": claude.parse, "codex": codex.parse}


def unparsed(batches: DataFrame) -> DataFrame:
    """agent, batches, entries of batches that no parser takes."""
    rest = batches.where(~F.coalesce(F.col("agent").isin(list(PARSERS)), F.lit(False)))
    return rest.groupBy("agent").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.size("entries")).alias("entries"))


def govern(rows: DataFrame, disclosure: str, redact: bool = True) -> DataFrame:
    """Parsed rows as the lake holds them: stripped, then redacted."""
    rows = governance.disclose(rows, disclosure)
    return governance.redact_table(rows) if redact else rows


def normalise_batches(batches: DataFrame, disclosure: str, redact: bool = True, session_key: str = "source",
                      models: DataFrame | None = None) -> DataFrame:
    """Shipped batches to governed trace rows: parse, then strip, then redact. ``models`` is
    the state of earlier runs. ``modified_at`` is when a row's batch came."""
    parsed = None
    for agent, parse in PARSERS.items():
        raw_lines = raw.from_batches(batches.where(F.col("agent") == agent), session_key)
        part = parse(raw_lines, models) if agent == "codex" else parse(raw_lines)
        parsed = part if parsed is None else parsed.unionByName(part)
    return govern(parsed, disclosure, redact)


def _once(rows: DataFrame) -> DataFrame:
    """One row per id and date; of rows without a time one per id, that of the first date."""
    dated = F.col("ts").isNotNull()
    own = W.partitionBy("id", dated, F.when(dated, F.col("event_date"))).orderBy("event_date")
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def append_new(rows: DataFrame, path: str) -> None:
    """Append the rows (with ``event_date``) whose id the table does not hold yet; of equal
    ids one stays. A row's date follows from its time, so ids are looked up under the dates of
    the rows only, which are few. A row without a time is filed under the day it came, which
    another load need not share: its id is looked up among all rows without a time, and
    file statistics tell where there are any. Rows are staged first."""
    spark, fresh = rows.sparkSession, runs.staged(_once(rows), "load")
    if exists(spark, path):
        dates = [r.event_date for r in fresh.where(F.col("ts").isNotNull()).select("event_date").distinct().collect()]
        held = read_traces(spark, path)
        dated = fresh.where(F.col("ts").isNotNull()).join(held.where(F.col("event_date").isin(dates)).select("id", "event_date"), ["id", "event_date"], "left_anti")
        undated = fresh.where(F.col("ts").isNull())
        if undated.limit(1).count():
            dated = dated.select(*fresh.columns).union(undated.join(held.where(F.col("ts").isNull()).select("id"), "id", "left_anti").select(*fresh.columns))
        fresh = dated
    write_traces(fresh, path)


def replace_changed(rows: DataFrame, path: str, *columns: str) -> None:
    """Put ``rows`` (with ``event_date``) in the place of those of equal id and date that
    differ in ``columns``. Only partitions with such rows are written again."""
    spark, rows = rows.sparkSession, runs.staged(rows, "again")
    dates = [r.event_date for r in rows.select("event_date").distinct().collect()]
    held = read_traces(spark, path).where(F.col("event_date").isin(dates))
    old = held.select("id", "event_date", F.struct(*columns).alias("_old"))
    changed = runs.staged(rows.dropDuplicates(["id", "event_date"]).join(old, ["id", "event_date"]).where(
        ~F.col("_old").eqNullSafe(F.struct(*columns))).select(*held.columns), "changed")
    parts = [(r.event_date, r.agent) for r in changed.select("event_date", "agent").distinct().collect()]
    if parts:
        rest = held.where(in_units(["event_date", "agent"], parts)).join(changed.select("id", "event_date"), ["id", "event_date"], "left_anti").select(*held.columns)
        write_traces(runs.staged(rest.union(changed), "replaced"), path, mode="overwrite")


def repartition_by_event(batches: DataFrame, path: str, disclosure: str, redact: bool = True, models: str | None = None,
                         zone: str | None = None) -> None:
    """Raw zone (by ship date) to normalised zone (by entry time), beside the rows of
    earlier runs. ``models`` is the folder of what logs carry from run to run; it is
    written after the rows, so a run that broke off can run again. A batch that sets a model
    may come after batches behind it: with ``zone``, the folder of all landed batches, those
    are parsed again, and their rows replaced where the model is another now."""
    spark, batches = batches.sparkSession, runs.staged(batches, "batches")
    state = spark.read.parquet(models) if models and exists(spark, models) else None
    rows = with_event_date(normalise_batches(batches, disclosure, redact, models=state), modified_at=F.col("modified_at"))
    append_new(rows.drop("modified_at"), path)
    if not models:
        return
    chunks = runs.staged(codex.model_state(raw.from_batches(batches.where(F.col("agent") == "codex"))), "chunks")
    if state is not None and zone:
        late = runs.staged(codex.overtaken(chunks, state), "overtaken")
        devs = [r.dev for r in late.select(governance.partition_hash(F.col("_developer")).alias("dev")).distinct().collect()]
        if devs:
            landed = read_batches(spark, zone).where((F.col("agent") == "codex") & F.col("dev").isin(devs))
            lines = codex.by_log(raw.from_batches(landed))
            behind = lines.join(late, codex.LOG).where("chunk > since").select(*[c for c in lines.columns if c not in codex.LOG])
            again = govern(codex.parse(behind, state.unionByName(chunks)), disclosure, redact)
            replace_changed(with_event_date(again, modified_at=F.col("modified_at")).drop("modified_at"), path, "model")
    chunks.write.mode("append").parquet(models)


def _dev(developer: str) -> str:
    """``governance.partition_hash`` of a name."""
    return hashlib.sha256(developer.encode()).hexdigest()[:12]


def erase_from_raw(spark: SparkSession, path: str, developer: str) -> int:
    """Delete every raw partition of one developer, over all dates. Works on
    directory names; returns how many went."""
    dev = _dev(developer)
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/year=*/month=*/day=*/agent=*/dev={dev}")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def erase_from_traces(traces: DataFrame, developer: str, path: str) -> int:
    """Write the traces without one developer, hashed name included, to the new ``path``;
    how many rows went. ``path`` must not hold rows: overwriting by partition would keep
    those partitions that have nothing left."""
    spark = traces.sparkSession
    if exists(spark, path):
        raise ValueError(f"{path} exists; erase into a fresh path and switch readers to it")
    gone = F.coalesce(F.col("developer").isin(developer) | (F.col("developer") == governance.anonymous(F.lit(developer))), F.lit(False))
    kept = traces.where(~gone)
    write_traces(kept if "event_date" in traces.columns else with_event_date(kept), path)
    return traces.where(gone).count()


def erase_developer(spark: SparkSession, out: str, fresh: str, developer: str) -> dict[str, int]:
    """All tables of ``out`` without one developer, in the new folder ``fresh``, to which
    readers are then switched; how many rows went, per table. Commits go by developer, author
    or e-mail; findings are made anew from the traces that are left."""
    name = developer.lower()
    git = read_git(spark, f"{out}/git_events").drop("event_date")
    theirs = F.coalesce(F.lower("author") == name, F.lit(False)) | F.coalesce(F.lower("author_email") == name, F.lit(False)) | F.coalesce(
        F.col("developer").isin(developer) | (F.col("developer") == governance.anonymous(F.lit(developer))), F.lit(False))
    gone = {"traces": erase_from_traces(read_traces(spark, f"{out}/traces"), developer, f"{fresh}/traces"), "git_events": git.where(theirs).count()}
    write_git(git.where(~theirs), f"{fresh}/git_events")
    write_findings(spark, fresh)
    before, after = (read_findings(spark, f"{at}/findings").count() for at in (out, fresh))
    return gone | {"findings": before - after}


def _of_developer(developer: str, column: str = "developer") -> Column:
    """The rows of a developer, hashed name included."""
    return F.coalesce(F.col(column).isin(developer) | (F.col(column) == governance.anonymous(F.lit(developer))), F.lit(False))


def take_out(spark: SparkSession, read: Callable[[], DataFrame], path: str, gone: Column, units: list[str]) -> tuple[int, int]:
    """Rewrite the files of the table at ``path`` that hold rows ``gone``, without these, and
    no others; how many rows went, and from how many files. ``read`` gives the table, whose
    partition columns are ``units``.

    What stays of the files is staged beside the table, then a list of the files; with it the
    new files move in and the old ones go, which a later run finishes if this one cannot.
    """
    _finish(spark, path)
    rows = read()
    hits = rows.where(gone).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not hits:
        return 0, 0
    jvm = spark.sparkContext._jvm
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.file)).toString() for r in hits]
    kept = spark.read.schema(rows.schema).option("basePath", path).parquet(*files).where(~gone)
    writer = (rebalance(kept, *units) if units else kept).write.mode("overwrite").option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
    (writer.partitionBy(*units) if units else writer).parquet(f"{path}/_out/rows")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_out/files")
    _finish(spark, path)
    return sum(r.n for r in hits), len(files)


def _finish(spark: SparkSession, path: str) -> None:
    staged = f"{path}/_out/rows"
    if exists(spark, f"{path}/_out/files/_SUCCESS"):
        old = [r.file for r in spark.read.parquet(f"{path}/_out/files").collect()]
        fs, top = _at(spark, staged)
        found, new = fs.listFiles(top, True), []
        while found.hasNext():
            new.append(found.next().getPath())
        for file in new:
            inner = file.toString().split("/_out/rows/", 1)[1]
            if inner.endswith(".parquet"):
                _, target = _at(spark, f"{path}/{inner}")
                fs.mkdirs(target.getParent())
                fs.rename(file, target)
        for file in old:
            delete(spark, file)
    delete(spark, f"{path}/_out")


def erase(spark: SparkSession, out: str, developer: str, zone: str | None = None, rejects: str | None = None) -> dict[str, tuple[int, int]]:
    """Take one developer out of all that a lake keeps, in place: traces and what is derived
    from them, commits (by developer, author or e-mail), what logs carry from run to run, the
    landing ``zone`` with its ids, and refused batches. Per table how many rows went and how
    many files were written again (for the zone: partitions, which go whole). Daily usage has
    no developer. The partitions to refresh are noted first, so a run that broke off can run
    again."""
    from spoor.plans import derived

    name, noted = developer.lower(), f"{out}/_erasing"
    _finish(spark, f"{out}/traces")
    touched = read_traces(spark, f"{out}/traces").where(_of_developer(developer)).select(*derived.PART).distinct()
    if exists(spark, f"{noted}/_SUCCESS"):
        touched = touched.union(spark.read.schema(touched.schema).parquet(noted)).distinct()
    parts = derived.touched_by(touched)
    spark.createDataFrame(parts, touched.schema).coalesce(1).write.mode("overwrite").parquet(noted)
    gone = {"traces": take_out(spark, lambda: read_traces(spark, f"{out}/traces"), f"{out}/traces", _of_developer(developer), derived.PART)}
    if exists(spark, f"{out}/git_events"):
        theirs = _of_developer(developer) | F.coalesce(F.lower("author") == name, F.lit(False)) | F.coalesce(F.lower("author_email") == name, F.lit(False))
        gone["git_events"] = take_out(spark, lambda: read_git(spark, f"{out}/git_events", linked=True), f"{out}/git_events", theirs, ["event_date", "repo_hash"])
    if exists(spark, f"{out}/models"):
        gone["models"] = take_out(spark, lambda: spark.read.parquet(f"{out}/models"), f"{out}/models", _of_developer(developer, "_developer"), [])
    if rejects and exists(spark, rejects):
        schema = T.StructType([*S.BATCH.fields, T.StructField("epoch", T.LongType())])
        gone["rejects"] = take_out(spark, lambda: spark.read.schema(schema).parquet(rejects), rejects, _of_developer(developer), ["epoch"])
    if zone:
        gone["raw"] = (erase_from_raw(spark, zone, developer), 0)
        delete(spark, f"{zone}_ids/{partition_path(dev=_dev(developer))}")
    derived.refresh(spark, out, parts)
    delete(spark, noted)
    return gone


# ---- incremental --------------------------------------------------------------

def only_new(rows: DataFrame, shipped: DataFrame) -> DataFrame:
    """Rows whose id was not exported before."""
    return rows.join(shipped.select("id").distinct(), "id", "left_anti")


def git_since_mark(git: DataFrame, marks: DataFrame) -> DataFrame:
    """Commits on or after each repository's mark. The last day is read again: it
    was not over when it was read. marks: repo, mark (date)."""
    day = F.substring("timestamp_text", 1, 10).try_cast("date")
    return (
        git.join(marks.select("repo", "mark"), "repo", "left")
        .where(F.col("mark").isNull() | (day >= F.col("mark"))).drop("mark")
    )


def next_marks(git: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks after a run."""
    day = F.substring("timestamp_text", 1, 10).try_cast("date")
    seen = git.groupBy("repo").agg(F.max(day).alias("mark"))
    return seen.unionByName(marks.select("repo", "mark")).groupBy("repo").agg(F.max("mark").alias("mark"))


def git_backfill(git: DataFrame, marks: DataFrame, since: str) -> DataFrame:
    """History behind the marks: [since, mark), or all of it where there is no
    mark. Sessions are not attributed and marks do not move."""
    day = F.substring("timestamp_text", 1, 10).try_cast("date")
    return (
        git.where(day >= F.lit(since).cast("date")).join(marks.select("repo", "mark"), "repo", "left")
        .where(F.col("mark").isNull() | (day < F.col("mark"))).drop("mark")
    )


# ---- the load -----------------------------------------------------------------

def build_tables(spark: SparkSession, root: str, out: str, developer: str | None = None) -> None:
    """Normalised text files to the three query tables: traces with usage rows,
    findings, commits of one developer linked to sessions. A full build replaces all of
    ``out``'s tables: partitions without rows in this build go too."""
    traces = normalised.read_traces(spark, root, file_date=True)
    if normalised.stage_usage(spark, root, f"{out}/usage"):
        traces = traces.unionByName(normalised.read_usage(spark, f"{out}/usage"), allowMissingColumns=True)
    write_traces(with_event_date(traces, modified_at=F.col("event_date")), f"{out}/traces", mode="overwrite", whole=True)
    stored = read_traces(spark, f"{out}/traces")
    write_findings(spark, out)
    git = attribution.filter_author(normalised.read_git(spark, root), developer)
    write_git(attribution.link_commits(git, stored, mark="linked_by"), f"{out}/git_events", mode="overwrite", whole=True)


def write_findings(spark: SparkSession, out: str) -> None:
    """All that is derived from the traces of ``out``; see ``derived``."""
    from spoor.plans import derived

    derived.build(spark, out)
