"""Line dedup by levelled sorted runs of line hashes.

A run is a table `h1, h2, n, top` of 128-bit line hashes with the number of documents that hold
the line and the largest of their ids, bucketed and sorted by the hash, so runs meet each other
and a new batch by merge joins that move only the batch. A batch is aggregated before its
shuffle, loses by anti-joins the lines that a run has settled (found in enough documents, none
of the batch's ids larger than the run's), and adds the others as a run of level 0. Two runs of
a level are merged, bucket by bucket and without a shuffle, into one run of the next level.

Counts of unsettled lines add up over the runs, so nothing is lost by the anti-joins and batches
may come in any order; in falling order of ids most repeated lines are settled early.
"""

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardfit.functions.checkpoints import delete, shared_folder
from shardfit.llm.common import fresh, slices

SPACE = b" \t\n\x0b\x0c\r"
RUN_ROWS = 1_000_000        # lines of all documents for each bucket of a run, up to the number of shuffle partitions


def line_hash(line: bytes, least_chars: int) -> bytes | None:
    """Hash of the line's key in UTF-8; None for keys of fewer code points."""
    key = line.strip(SPACE).lower()  # bytes: A-Z alone change
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def hashed_lines(docs: DataFrame, least_chars: int = 20, key="doc_id", text="text") -> DataFrame:
    """`key, h1, h2`: the distinct long lines of every row. Narrow."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found, count = [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    own = {line_hash(line, least_chars) for line in (raw or b"").split(b"\n")}
                    own.discard(None)
                    found.extend(own)
                    count.append(len(own))
                words = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                rows = pa.array(np.repeat(np.arange(part.num_rows), count))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(rows), pa.array(words[:, 0]), pa.array(words[:, 1])], ["key", "h1", "h2"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, h1 long, h2 long")


class LineRuns:
    """The runs seen so far. `add` batches of `hashed_lines`; no document may come twice.

    With as many buckets as shuffle partitions, a batch's aggregation already deals it out as the
    runs are; fewer are for small tables.
    """

    def __init__(self, spark: SparkSession, least_docs: int = 3, buckets: int | None = None):
        self.spark, self.least_docs = spark, least_docs
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(buckets or self.partitions, self.partitions)
        self.levels: list[str | None] = []  # one run of each level, or none

    def _write(self, run: DataFrame) -> str:
        name = f"shardfit_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, f"{shared_folder(self.spark)}/{name}")

    def _merge(self, one: str, other: str) -> str:
        """One run from two, bucket by bucket; the two are deleted once it is written."""
        a, b = self.spark.table(one), self.spark.table(other).withColumnsRenamed({"n": "m", "top": "best"})
        both = a.join(b.hint("merge"), ["h1", "h2"], "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        name = self._write(both.select("h1", "h2", n.alias("n"), F.greatest("top", "best").alias("top")))
        self._remove(one)
        self._remove(other)
        return name

    def add(self, lines: DataFrame) -> None:
        """Add the lines of further documents; two runs of a level become one of the next."""
        own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("key").alias("top"))
        for name in filter(None, self.levels):
            seen = self.spark.table(name).where(F.col("n") >= self.least_docs).select(
                "h1", "h2", F.col("top").alias("seen")).hint("merge")
            settled = F.coalesce(F.col("seen") >= F.col("top"), F.col("top").isNull())
            own = own.join(seen, (own["h1"] == seen["h1"]) & (own["h2"] == seen["h2"]) & settled, "left_anti")
        if self.buckets < self.partitions:
            own = own.repartition(self.buckets, "h1", "h2")
        run = self._write(own)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append(None)
            if self.levels[level] is None:
                self.levels[level] = run
                break
            run, self.levels[level] = self._merge(self.levels[level], run), None

    def repeated(self) -> DataFrame:
        """`h1, h2, top` of the lines that enough documents hold, from one last run of all."""
        names = [n for n in self.levels if n]
        self.levels = [reduce(self._merge, names)]
        return self.spark.table(self.levels[0]).where(F.col("n") >= self.least_docs).select("h1", "h2", "top")

    def close(self) -> None:
        """Delete the runs."""
        for name in filter(None, self.levels):
            self._remove(name)
        self.levels = []


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4,
                        key="doc_id", text="text") -> DataFrame:
    """Every document without the lines that at least `least_docs` documents hold.

    Columns: key, text, n_lines (before), n_dropped. Lines end at \\n; a line's key is the line
    without ASCII white space at its ends, A-Z lower-cased; keys of fewer than `least_chars` code
    points always stay. A repeated line stays in the document of the largest id alone, and there
    all its occurrences do. Ids are numbers. Rows with equal ids are documents of their own that
    rank alike; null ids rank below all others and alike. A null or empty text is one empty line.
    An empty table gives an empty result. Other columns are not read.

    Batches are ranges of ids, largest first. A document's dropped hashes are one list, so a task
    holds one text, its lines and its list at a time; nothing else grows with the table.
    """
    spark = docs.sparkSession
    cuts = [1 - (i + 1) / batches for i in range(batches - 1)]
    bounds = docs.approxQuantile(key, cuts, 0.01) if cuts else []
    batch = sum([F.when(F.col("key") < b, 1).otherwise(0) for b in bounds], F.lit(0))
    batch = F.when(F.col("key").isNull(), F.lit(len(bounds))).otherwise(batch).alias("batch")
    folder = f"{shared_folder(spark)}/shardfit-lines-{uuid.uuid4().hex}"
    rows = hashed_lines(docs, least_chars, key, text).select("*", batch).sortWithinPartitions("batch")
    rows.write.parquet(f"{folder}/lines")
    lines = spark.read.schema(rows.schema).parquet(f"{folder}/lines")
    runs = LineRuns(spark, least_docs, 1 + lines.count() // RUN_ROWS)
    for b in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == b))
    runs.repeated().write.parquet(f"{folder}/repeated")
    runs.close()
    repeated = spark.read.schema(f"h1 long, h2 long, top {rows.schema['key'].dataType.simpleString()}").parquet(
        f"{folder}/repeated")
    # both sides are shuffled on the hash, so that Spark splits a line that very many documents hold
    doomed = lines.join(repeated.hint("merge"), ["h1", "h2"]).where(
        ~F.col("key").eqNullSafe(F.col("top"))).groupBy("key").agg(F.collect_list(F.struct("h1", "h2")).alias("hashes"))
    doomed.write.parquet(f"{folder}/doomed")
    doomed = spark.read.schema("key {}, hashes array<struct<h1:bigint,h2:bigint>>".format(
        rows.schema["key"].dataType.simpleString())).parquet(f"{folder}/doomed")
    delete(spark, f"{folder}/lines")
    delete(spark, f"{folder}/repeated")
    # lists of hashes grow with the table, so the texts meet them by a shuffle at every size; a hash
    # table of the lists, which are far smaller, spares the sort of the texts
    doomed = doomed.hint("shuffle_hash")
    source = docs.select(F.col(key).alias("own"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    joined = source.join(doomed, source["own"].eqNullSafe(doomed["key"]), "left").select("own", "text", "hashes")

    def run(parts):
        for whole in parts:
            for part in slices(whole, "text"):
                yield _without(part, least_chars)

    kind = rows.schema["key"].dataType.simpleString()
    out = joined.mapInArrow(run, f"own {kind}, text string, n_lines long, n_dropped long")
    return out.withColumnRenamed("own", key).withColumnRenamed("text", text if text != key else fresh(out, "text"))


def _without(part: pa.RecordBatch, least_chars: int) -> pa.RecordBatch:
    texts, hashes = part.column("text"), part.column("hashes")
    n_lines = pa.compute.add(pa.compute.count_substring(texts, "\n").cast(pa.int64()), 1)
    n_dropped = np.zeros(part.num_rows, np.int64)
    touched = np.flatnonzero(hashes.is_valid().to_numpy(zero_copy_only=False))
    if len(touched):
        kept = texts.to_pylist()
        for i in touched:
            found = hashes[i].values
            raw = np.column_stack([found.field(f).to_numpy() for f in ("h1", "h2")]).astype("<i8").tobytes()
            gone = {raw[at:at + 16] for at in range(0, len(raw), 16)}
            lines = kept[i].encode().split(b"\n")
            stay = [line for line in lines if line_hash(line, least_chars) not in gone]
            n_dropped[i] = len(lines) - len(stay)
            kept[i] = b"\n".join(stay).decode()
        texts = pa.array(kept, pa.string())
    return pa.RecordBatch.from_arrays([part.column("own"), texts, n_lines, pa.array(n_dropped)],
                                      ["own", "text", "n_lines", "n_dropped"])
