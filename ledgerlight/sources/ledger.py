"""The audit ledger: append-only files of JSON lines, each line chained to the one before by SHA-256.

A folder of ledgers holds one ledger for each value of a key column. An append writes its lines to a folder of its own and
then takes the next commit number by creating a file that can be created once only, so a half-written append is invisible,
and of two writers that go on from the same state one fails. Lines are ordered by commit number and place in the commit's
file; times and names of files don't count, so folders may be copied and touched. A plain file of lines is a ledger too.

Chaining is sequential by nature, so scale comes from many ledgers; within one, a task streams its lines in constant memory.
Reading and verifying aren't: lines are numbered by file split and verified in segments, each of which yields where it ends,
and only those ends are looked at in order. Verifying a line's own hash needs no order at all. Neither shuffles the lines
themselves: numbers come from a broadcast of where each split starts, and what is put in order of a line is its links.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import exists, listed, matching, publish

GENESIS = "0" * 64
SUMMARY = "pipeline_summary"
#: Name of the ledger of records whose key is null or empty.
NO_KEY = "(none)"
#: Lines of a segment that a verifier looks at in order.
SEGMENT = 1 << 16
_VIOLATIONS = "array<struct<rule:string,description:string,evidence:string,severity:string,remediation:string,confidence:double>>"
_STEPS = "array<struct<stepIndex:int,timestamp:string,action:string,input:string,output:string,durationMs:bigint,metadata:map<string,string>>>"
_STAGES = f"array<struct<name:string,auditId:string,parentTraceId:string,blocked:boolean,riskLevel:string,violations:{_VIOLATIONS},explanation:string,result:string,durationMs:bigint>>"
#: Columns of a trace line in the order in which they are written and hashed, without the chain's own.
TRACE = f"id string, started_at string, input string, steps {_STEPS}, blocked boolean, risk_level string, explanation string, reason string, violations {_VIOLATIONS}, result string, created_at string, timestamp string, metadata map<string,string>, pipeline_id string, parent_trace_id string, agent_name string"
CHAIN = "seq bigint, prev_hash string, row_hash string"
#: All columns of either kind; audit_id and audit_trail are how the lite dialect calls id and steps.
ANY = ", ".join(dict.fromkeys(f"{a}" for a in [*TRACE.split(", "), "_type string", "pipeline_name string", f"stages {_STAGES}", "short_circuited boolean", "blocked_at string", "total_duration_ms bigint", *CHAIN.split(", "), "audit_id string", f"audit_trail {_STEPS}"]))


def path_of(path: str) -> str:
    """Ledger paths that end in .db are files of JSON lines all the same."""
    return path.removesuffix(".db") + ".ndjson" if path.endswith(".db") else path


def config(path: str, explicit: dict | None = None) -> dict:
    """Options from a JSON file, if it is there and valid, overridden by explicit ones."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        found = {}
    return {**(found if isinstance(found, dict) else {}), **(explicit or {})}


def _decoded(part: Column) -> Column:
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _plain_path(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


class AppendConflict(RuntimeError):
    """Another append has taken the commit number: read the ledgers' state again, and chain on from that."""


def commits(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, folder, append id) of the appends to the ledgers at ``path``, a row for each append."""
    if not exists(spark, f"{path}/_commits"):
        return []
    found = spark.read.text(f"{path}/_commits/[0-9]*").select(F.regexp_extract("_metadata.file_path", r"(\d+)$", 1).cast("bigint"), F.split("value", " ", 2))
    return sorted((n, parts[0], parts[1] if len(parts) > 1 else "") for n, parts in found.collect())


def last_commit(spark: SparkSession, path: str) -> int:
    """The number of the last append, 0 before the first. Give what it was before ``chain_state`` to ``append``."""
    return max((n for n, _, _ in commits(spark, path)), default=0)


LINES = "ledger string, append string, commit bigint, n bigint, line string"


def numbered(spark: SparkSession, path: str, but: set[str] = frozenset()) -> DataFrame:
    """(ledger, append, commit, n, line): lines with their numbers, from 0, within what each append gave a ledger.

    ``append`` is the append's folder; what no commit names (plain files, old layouts) has none, and commit 0. Appends in
    ``but`` aren't read. Files are read by lines and in parts, so a ledger may be of any size: lines are numbered within
    their part, and parts by the number of lines before them. Compressed files are one part each.
    """
    return _numbered(spark, path, but).drop("line_no")


def _numbered(spark: SparkSession, path: str, but: set[str] = frozenset()) -> DataFrame:
    """``numbered`` lines with line_no, their numbers within the whole ledger."""
    places = matching(spark, path_of(path))
    by_commits = [p for p in places if exists(spark, f"{p}/_commits")]
    appended = [(place, n, folder) for place in by_commits for n, folder, _ in commits(spark, place) if folder not in but]
    # Besides its appends a folder may hold ledgers from before there were commits: those lines come first.
    plain = [p for p in places if p not in by_commits] + [f for p in by_commits for f in listed(spark, f"{p}/ledger=*")]
    if not plain and not appended:
        return spark.createDataFrame([], f"{LINES}, line_no bigint")
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").schema("value string")
    found = reader.text([*plain, *[f"{place}/{folder}" for place, _, folder in appended]]).filter("value <> ''").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line")
    )
    names = {p: p.rstrip("/").rpartition("/")[2] for p in places}
    names = names if len(set(names.values())) == len(places) else {p: p for p in places}
    numbers = spark.createDataFrame([(_plain_path(f"{place}/{folder}"), folder, n, names[place]) for place, n, folder in appended], "at string, append string, commit bigint, place string")
    at = F.regexp_replace(_decoded(F.regexp_extract("file", "^(.*/data-[0-9a-f]{32})/", 1)), "^file:/+", "file:/")
    key = _decoded(_decoded(F.regexp_extract("file", "/ledger=([^/]+)/[^/]+$", 1)))  # once as a URL, once as a folder's name
    place = F.coalesce("place", F.regexp_extract("file", "([^/]+)/ledger=[^/]+/[^/]+$", 1))
    named = key if len(places) == 1 else F.concat(place, F.lit("/"), key)
    # Lines of a part have consecutive numbers in its task: where those begin and how many there are places them all.
    parts = found.groupBy("file", "part").agg(F.count("*").alias("size"), F.min("nth").alias("first"))
    parts = parts.withColumn("at", at).join(F.broadcast(numbers), "at", "left")  # a row for each append
    parts = parts.withColumns({"ledger": F.when(key == "", F.col("file")).otherwise(named), "commit": F.coalesce("commit", F.lit(0))})

    def starts(window):
        return F.coalesce(F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    own, whole = Window.partitionBy("ledger", "commit").orderBy("file", "part"), Window.partitionBy("ledger").orderBy("commit", "file", "part")
    parts = parts.select("file", "part", "size", "first", "ledger", "append", "commit", starts(own).alias("in_append"), starts(whole).alias("in_ledger"))
    # A row for each part, of which the driver keeps a list anyway. A file that grows may show one line more than were counted.
    nth = F.col("nth") - F.col("first")
    within = F.when(nth.between(0, F.col("size")), nth).otherwise(F.raise_error(F.lit("files were split anew while they were read: read them again")))
    found = found.join(F.broadcast(parts), ["file", "part"], "left").withColumn("within", within)
    return found.select("ledger", "append", "commit", (F.col("in_append") + F.col("within")).alias("n"), "line", (F.col("in_ledger") + F.col("within")).alias("line_no"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ledger, line_no, line) with exact bytes and numbers from 0; empty lines don't count, a missing file has none.

    ``path`` may be a pattern; one that matches nothing raises. A ledger is what one ``ledger=`` folder holds, by commits or
    else by the names of its files, or a file by itself. If several folders match, names of ledgers start with the folder's.
    """
    return _numbered(spark, path).select("ledger", "line_no", "line")


def parsed(raw: DataFrame) -> DataFrame:
    """Lines with a struct ``r`` of all known columns and a flag ``corrupt``."""
    schema = f"{ANY}, _corrupt string"
    out = raw.withColumn("r", F.from_json("line", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    return out.withColumn("corrupt", F.col("r").isNull() | F.col("r._corrupt").isNotNull())


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Records of ledgers with line_no. Strict: a ledger with any bad line has none; tolerant: bad lines are left out."""
    rows = parsed(lines(spark, path))
    if strict:
        rows = rows.join(rows.filter("corrupt").select("ledger").distinct(), "ledger", "left_anti")
    return records(rows.filter("not corrupt"))


def records(rows: DataFrame) -> DataFrame:
    """Columns of parsed lines, the lite dialect's names made ours."""
    good = rows.select("ledger", "line_no", "r.*").drop("_corrupt")
    return good.withColumn("id", F.coalesce("id", "audit_id")).withColumn("steps", F.coalesce("steps", "audit_trail")).drop("audit_id", "audit_trail")


def tail_scan(raw: DataFrame, limit: int = 50) -> DataFrame:
    """The lite dialect's read: each ledger up to its first bad line, of that the last ``limit`` records, newest first."""
    rows = parsed(raw)
    bad = rows.filter("corrupt").groupBy("ledger").agg(F.min("line_no").alias("__bad"))
    kept = rows.join(bad, "ledger", "left").filter(F.col("__bad").isNull() | (F.col("line_no") < F.col("__bad"))).drop("__bad")
    newest = kept.withColumn("nth", F.row_number().over(Window.partitionBy("ledger").orderBy(F.desc("line_no")))).filter(F.col("nth") <= limit)
    return records(newest)


def verdict_rows(records: DataFrame) -> DataFrame:
    """Trace records as verdicts: audit_id, and the time of the verdict or else of the line."""
    t = traces(records)
    return t.select("ledger", "line_no", F.col("id").alias("audit_id"), "blocked", "risk_level", "reason", "explanation", "violations", "result", F.coalesce("timestamp", "created_at").alias("timestamp"), "metadata", "pipeline_id", "parent_trace_id", "agent_name", "started_at")


def summary_rows(records: DataFrame) -> DataFrame:
    """Summary records as flow.summaries gives them."""
    return pipelines(records).select("ledger", "line_no", "pipeline_id", "pipeline_name", "stages", "short_circuited", "blocked_at", "total_duration_ms", F.coalesce("timestamp", "created_at").alias("timestamp"))


def traces(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("_type").eqNullSafe(F.lit(SUMMARY)))


def pipelines(records: DataFrame) -> DataFrame:
    return records.filter(F.col("_type") == SUMMARY)


def tail(records: DataFrame, limit: int = 50) -> DataFrame:
    """The last records, newest first; summaries included."""
    return records.orderBy(F.desc("line_no")).limit(limit)


def payload(df: DataFrame, columns: list[str]) -> Column:
    """A record's JSON in the order given, nulls written out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def summary_payload(df: DataFrame, columns: list[str]) -> Column:
    """A pipeline summary's JSON: its type first, then the columns in the order given."""
    return F.to_json(F.struct(F.lit(SUMMARY).alias("_type"), *[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def chain_state(raw: DataFrame) -> DataFrame:
    """(ledger, prev_hash, seq): where the next line of each ledger starts."""
    last = raw.groupBy("ledger").agg(F.max_by("line", "line_no").alias("line"), F.count("*").alias("n"))
    r = F.from_json("line", "seq bigint, row_hash string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    corrupt = r.isNull() | r["_corrupt"].isNotNull()
    seq = F.when(corrupt, 0).when(r["seq"].isNotNull(), r["seq"] + 1).otherwise(F.col("n") - 1)
    return last.select("ledger", F.coalesce(r["row_hash"], F.lit(GENESIS)).alias("prev_hash"), seq.cast("bigint").alias("seq"))


def ledger_key(key: Column) -> Column:
    """What names a record's ledger: its key as text; null and empty keys share one."""
    text = key.cast("string")
    return F.when(text != "", text).otherwise(NO_KEY)


def linked(text: str | None, seq: int, prev: str) -> tuple[str, str]:
    """(line, its hash): a record's JSON with its place in the chain. Null stands for an empty object; line ends become
    blanks; what isn't an object raises."""
    body = ("{}" if text is None else text).strip().replace("\n", " ")
    if not (body.startswith("{") and body.endswith("}")):
        raise ValueError(f"a ledger's records are JSON objects, not {body[:80]!r}")
    start = f"{body[:-1]}," if body[1:-1].strip() else "{"
    hashed = f'{start}"seq":{seq},"prev_hash":"{prev}"}}'
    digest = hashlib.sha256(hashed.encode()).hexdigest()
    return f'{hashed[:-1]},"row_hash":"{digest}"}}', digest


def gathered(rows: DataFrame, ledger: str, order: str) -> DataFrame:
    """``rows`` with each ledger's in one task and in order, for ``chained(..., gathered=True)``.

    What a record is made from is often far smaller than its JSON: if that is gathered and the JSON made by narrow steps
    after it, no JSON is shuffled. There are as many parts as the session's shuffles have, as the work on them isn't as small
    as they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ledger_key(F.col(ledger))
    return rows.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key, order)


def _gathered(rows: DataFrame) -> DataFrame:
    """``rows`` with each ledger's in one task.

    By a hash of the key: after a join by the key itself Spark leaves a repartition by it out, and may then read the join's
    shuffle by map task, where it broadcasts the other side, or in parts, where a ledger is large.
    """
    return rows.repartition(F.xxhash64("ledger"))


def chained(records: DataFrame, ledger: str, order: str, json_column: str, state: DataFrame | None = None, gathered: bool = False) -> DataFrame:
    """(ledger, seq, prev_hash, row_hash, line): records of each ledger in order, chained on from ``state``.

    ``gathered``: the function of that name has dealt the records out, and only narrow steps have changed them since.
    """
    if gathered and state is not None:
        raise ValueError("a join with a state may deal gathered records out anew")
    rows = records.select(ledger_key(F.col(ledger)).alias("ledger"), F.col(order).alias("o"), F.col(json_column).alias("json"))
    if state is not None:
        rows = rows.join(state.select("ledger", F.col("prev_hash").alias("p"), F.col("seq").alias("s")), "ledger", "left")
    else:
        rows = rows.withColumns({"p": F.lit(None).cast("string"), "s": F.lit(None).cast("bigint")})

    def run(batches):
        now, prev, seq = None, GENESIS, 0
        for batch in batches:
            out = []
            for key, text, p, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, prev, seq = key, p or GENESIS, s or 0
                line, digest = linked(text, seq, prev)
                out.append((key, seq, prev, digest, line))
                prev, seq = digest, seq + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["ledger", "seq", "prev_hash", "row_hash", "line"])

    ordered = rows if gathered else _gathered(rows).sortWithinPartitions("ledger", "o")
    return ordered.select("ledger", "json", "p", "s").mapInArrow(run, "ledger string, seq bigint, prev_hash string, row_hash string, line string")


def commit(spark: SparkSession, path: str, write: Callable[[str], None], after: int | None = None, append_id: str = "") -> int:
    """Let ``write`` fill a folder under ``path`` and make it an append; its number. See ``append``."""
    if re.search(r"\s", append_id):
        raise ValueError("an append id has no white space")
    done = commits(spark, path)
    again = [n for n, _, own in done if append_id and own == append_id]
    if again:
        return again[0]
    number = (max((n for n, _, _ in done), default=0) if after is None else after) + 1
    folder = f"data-{uuid.uuid4().hex}"
    write(f"{path}/{folder}")
    if not publish(spark, f"{path}/_commits/{number:012d}", f"{folder} {append_id}".strip()):
        raise AppendConflict(f"another append to {path} has taken number {number}")
    return number


def _commit(rows: DataFrame, path: str, after: int | None, append_id: str, compression: str | None = None) -> int:
    return commit(rows.sparkSession, path, lambda folder: rows.write.partitionBy("ledger").text(folder, compression=compression), after, append_id)


def append(chained_rows: DataFrame, path: str, after: int | None = None, append_id: str = "", gathered: bool = False, compression: str | None = None) -> int:
    """Append chained lines to the ledgers at ``path``, a file for each ledger; the append's number.

    ``after`` is the last commit that the rows were chained on from: if another append has come since, this one raises
    AppendConflict and shows nothing. An append whose ``append_id`` is there already does nothing, so it may be tried again.
    What failed appends have written stays in folders that no commit names.

    ``gathered``: the rows are as ``chained`` has made them, each ledger's in one task, and aren't shuffled again.
    ``compression`` is one of Spark's for text ("gzip"); a compressed file is read by one task, with the same lines.
    """
    one = (chained_rows if gathered else chained_rows.repartition("ledger")).sortWithinPartitions("ledger", "seq").select("ledger", F.col("line").alias("value"))
    return _commit(one, path, after, append_id, compression)


def append_plain(records: DataFrame, ledger: str, order: str, json_column: str, path: str, append_id: str = "") -> int:
    """Append lines without a chain, as the lite dialect does; a verifier counts them as legacy. A ledger's lines go to as
    many files as its size asks for, in order by their names."""
    rows = records.select(ledger_key(F.col(ledger)).alias("ledger"), F.col(order).alias("o"), F.col(json_column).alias("value"))
    dealt = rows.repartitionByRange("ledger", "o").sortWithinPartitions("ledger", "o").select("ledger", "value")
    return _commit(dealt, path, None, append_id)


def _hash_fits(line: Column, row_hash: Column) -> Column:
    """Whether a line without its row_hash has that hash, the other bytes as they are, wherever among its keys that stands.

    At its end, where lines are written with it, one replacement finds it. Elsewhere nested objects may hold such a pair as
    well, so leaving out any of the pairs with this very hash may fit.
    """
    last = F.sha2(F.concat(F.regexp_replace(line, r',"row_hash":"[^"]*"\}\s*$', ""), F.lit("}")), 256)
    pair = F.concat(F.lit('"row_hash":"'), row_hash, F.lit('"'))

    def without(parts: Column, i: Column) -> Column:
        left, right = (F.call_function("array_join", side, pair) for side in (F.slice(parts, 1, i), F.slice(parts, i + 1, F.size(parts) - i)))
        return F.when(left.endswith(","), F.concat(F.substr(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat(left, F.regexp_replace(right, "^,", "")))

    pieces = F.split(line, F.concat(F.lit(r"\Q"), pair, F.lit(r"\E")))
    any_fits = F.exists(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.sha2(without(pieces, i), 256) == row_hash)
    return F.when(last == row_hash, True).when(row_hash.rlike("^[0-9a-f]{64}$") & (F.size(pieces) > 1), any_fits).otherwise(False)


def _links(raw: DataFrame, *keys: str) -> DataFrame:
    """(keys, corrupt, legacy, bad_hash, row_hash, prev_hash, seq, id) of lines: what is left to judge needs order, but no line."""
    p = parsed(raw).select(*keys, "line", "corrupt", "r.row_hash", "r.prev_hash", "r.seq", F.coalesce("r.id", "r.audit_id", "r.pipeline_id", F.lit("unknown")).alias("id"))
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    p = p.withColumn("legacy", ~F.col("corrupt") & (empty("row_hash") | empty("prev_hash") | F.col("seq").isNull()))
    return p.withColumn("bad_hash", ~F.col("corrupt") & ~F.col("legacy") & ~_hash_fits(F.col("line"), F.col("row_hash"))).drop("line")


def faults(raw: DataFrame) -> DataFrame:
    """Lines (ledger, line_no, line) with what the verifier finds: legacy, corrupt, gap, bad_link, bad_hash, expected_seq.

    A first pass finds the last chained line of each segment of SEGMENT lines; what is the last one before each segment is
    worked out from these alone. A second one judges the lines, each segment by itself.
    """
    p = _links(raw, "ledger", "line_no").withColumn("segment", F.floor(F.col("line_no") / SEGMENT))
    valid = ~F.col("corrupt") & ~F.col("legacy")
    chained_line = F.when(valid, F.struct("line_no", "seq", "row_hash"))
    before = Window.partitionBy("ledger").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = p.groupBy("ledger", "segment").agg(F.max(chained_line).alias("end")).withColumn("carried", F.last("end", ignorenulls=True).over(before))
    p = p.join(ends.filter("carried is not null").select("ledger", "segment", "carried"), ["ledger", "segment"], "left")
    inside = Window.partitionBy("ledger", "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("__last", F.coalesce(F.last(chained_line, ignorenulls=True).over(inside), "carried"))
    expected = F.coalesce(F.col("__last.seq") + F.col("line_no") - F.col("__last.line_no"), F.col("line_no").cast("bigint"))
    return p.select(
        "ledger", "line_no", "id", "seq", "corrupt", "legacy", expected.alias("expected_seq"),
        (valid & (F.col("seq") != expected)).alias("gap"),
        (valid & (F.col("prev_hash") != F.coalesce("__last.row_hash", F.lit(GENESIS)))).alias("bad_link"),
        "bad_hash",
    )


def integrity(raw: DataFrame) -> DataFrame:
    """One row for each ledger: total_records, legacy_records, broken_links, sequence_gaps, intact."""
    n = lambda c: F.count_if(F.col(c)).cast("bigint")
    out = faults(raw).groupBy("ledger").agg(F.count("*").alias("total_records"), n("legacy").alias("legacy_records"), (n("corrupt") + n("bad_link") + n("bad_hash")).alias("broken_links"), n("gap").alias("sequence_gaps"))
    return out.withColumn("intact", (F.col("broken_links") == 0) & (F.col("sequence_gaps") == 0))

