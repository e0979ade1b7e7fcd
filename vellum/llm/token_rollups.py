"""Token totals by source, language and tokenizer version, kept up by signed deltas.

Method: a batch of changes (insert, revise, delete) is compared with the
documents' state and turned into signed ledger rows: what a document counted
before with a minus, what it counts now with a plus. The rows of a batch are
summed by source, language, tokenizer and kind of change into its delta; the
totals are the sum of the deltas of all committed batches. Both are additive,
so order does not matter and nothing is recounted.

Commits: a log of numbered entries names the tables that count. A batch writes
its ledger and delta into folders of its own, then claims the next number by a
rename that fails if another writer was first; it then starts over on what that
writer left. So entries are applied one after another, a driver lost before its
claim leaves nothing that counts, and a batch id that the log knows is not
applied again. A commit looks up the state of the changed documents only.
``compact`` sums what counts into one entry, which also holds the ids applied so
far: they stay applied. Older entries no longer count from then on, whether
their tables are already dropped or not.

Cases: of several changes of one document and tokenizer in a batch, the last by
(seq, n_tokens, source, lang) counts; an insert of a known document revises it;
a revision of an unknown one inserts it; its delete does nothing; rows with a
null doc_id or tokenizer are ignored; null sources and languages are groups of
their own; a null n_tokens counts 0; an empty batch commits; without batches
there are no totals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import default_path, encoder
from .words import small_batches

CHANGES = "seq long, op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"
LEDGER = "op string, doc_id long, tokenizer string, source string, lang string, d_docs long, d_tokens long"
DELTA = "op string, tokenizer string, source string, lang string, d_docs long, d_tokens long"


class TokenRollup:
    """Totals in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file_system(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[dict]:
        """Entries from the last compaction on, in order."""
        if not self._file_system().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")):
            return []
        entries = sorted((json.loads(r.value) for r in self.spark.read.text(f"{self.path}/log").collect()), key=lambda x: x["number"])
        last = max((k for k, x in enumerate(entries) if x["compacted"]), default=0)
        return entries[last:]

    def _claim(self, entry: dict) -> bool:
        """Puts an entry into the log, unless its number is taken."""
        jvm, fs = self.spark.sparkContext._jvm, self._file_system()
        path = jvm.org.apache.hadoop.fs.Path
        made, wanted = path(f"{self.path}/claim-{uuid.uuid4().hex}"), path(f"{self.path}/log/{entry['number']:012d}.json")
        fs.mkdirs(path(f"{self.path}/log"))
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(made, wanted, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if not fs.exists(wanted):
                raise
            fs.delete(made, False)
            return False
        return True

    def _applied(self, log: list[dict], batch: str) -> bool:
        if any(x["batch"] == batch for x in log):
            return True
        return bool(log and log[0]["compacted"]) and not self._read("applied", "id string", log[:1]).where(F.col("id") == batch).isEmpty()

    def committed(self) -> list[str]:
        """Ids of the entries that count, in order; their number is that of commits since the last compaction."""
        return [x["batch"] for x in self._log()]

    def is_committed(self, batch: str) -> bool:
        """Whether a batch was applied, be it that a compaction has replaced it."""
        return self._applied(self._log(), batch)

    def _at(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}/{name}"

    def _read(self, kind: str, schema: str, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._at(kind, x["name"]) for x in entries))

    def _state(self, entries: list[dict], keys: DataFrame | None = None) -> DataFrame:
        ledger = self._read("ledger", LEDGER, entries)
        if keys is not None:  # only these documents' rows are shuffled
            ledger = ledger.join(keys, ["doc_id", "tokenizer"], "left_semi")
        rows = ledger.groupBy("doc_id", "tokenizer", "source", "lang").agg(F.sum("d_docs").alias("d"), F.sum("d_tokens").alias("n_tokens"))
        return rows.where("d > 0").drop("d")

    def state(self) -> DataFrame:
        """doc_id, tokenizer, source, lang, n_tokens of the documents that now count."""
        return self._state(self._log())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once. False if it had been applied before."""
        cells = F.struct("seq", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang", "op")
        last = changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL").groupBy("doc_id", "tokenizer").agg(F.max(cells).alias("x")).select("doc_id", "tokenizer", "x.*")
        kept = None
        while True:
            log = self._log()
            if self._applied(log, batch):
                return False
            if kept is None:
                kept = shared.written(last, "changes")
            name = f"{uuid.uuid4().hex}"
            self._write(name, kept, log)
            if self._claim({"number": log[-1]["number"] + 1 if log else 0, "batch": batch, "name": name, "compacted": False}):
                return True
            self._drop(name)

    def _write(self, name: str, last: DataFrame, log: list[dict]) -> None:
        """Ledger and delta of a batch, given what counts before it."""
        before = self._state(log, last.select("doc_id", "tokenizer"))
        before = before.select("doc_id", "tokenizer", F.col("source").alias("s0"), F.col("lang").alias("l0"), F.col("n_tokens").alias("n0"))
        both = last.join(before, ["doc_id", "tokenizer"], "left")
        signed = lambda source, lang, docs, tokens: F.struct(source.alias("source"), lang.alias("lang"), F.lit(docs).cast("long").alias("d_docs"), tokens.alias("d_tokens"))
        minus = F.when(F.col("n0").isNotNull(), signed(F.col("s0"), F.col("l0"), -1, -F.col("n0")))
        plus = F.when(F.col("op") != "delete", signed(F.col("source"), F.col("lang"), 1, F.col("n_tokens")))
        rows = both.select("op", "doc_id", "tokenizer", F.explode(F.filter(F.array(minus, plus), lambda x: x.isNotNull())).alias("x"))
        ledger = rows.select("op", "doc_id", "tokenizer", "x.source", "x.lang", "x.d_docs", "x.d_tokens")
        ledger.write.mode("overwrite").parquet(self._at("ledger", name))
        self._sum(self._read("ledger", LEDGER, [{"name": name}])).write.mode("overwrite").parquet(self._at("delta", name))

    def _drop(self, name: str) -> None:
        for kind in ("applied", "ledger", "delta"):
            shared.drop(self.spark, self._at(kind, name))

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("op", "tokenizer", "source", "lang").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    def compact(self, batch: str) -> None:
        """Replaces all that counts by one entry of this (new) id; a batch of their ids is not applied again."""
        log = self._log()
        if not log or self._applied(log, batch):
            return
        name = uuid.uuid4().hex
        state = self._state(log).select(F.lit("insert").alias("op"), "doc_id", "tokenizer", "source", "lang", F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        state.write.parquet(self._at("ledger", name))
        self._sum(self._read("delta", DELTA, log)).write.parquet(self._at("delta", name))
        ids = self.spark.createDataFrame([(x["batch"],) for x in log], "id string")
        if log[0]["compacted"]:
            ids = ids.union(self._read("applied", "id string", log[:1]))
        ids.write.parquet(self._at("applied", name))
        if not self._claim({"number": log[-1]["number"] + 1, "batch": batch, "name": name, "compacted": True}):
            self._drop(name)  # another writer was first: the next compaction takes all up
            return
        # from the claim on these no longer count; what a lost driver leaves of them is never read again
        for x in log:
            self._drop(x["name"])
            shared.drop(self.spark, f"{self.path}/log/{x['number']:012d}.json")

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, and the tokens that inserts, revisions and deletes brought."""
        of = lambda op: F.sum(F.when(F.col("op") == op, F.col("d_tokens")).otherwise(0)).alias(f"{op}_tokens")
        deltas = self._read("delta", DELTA, [x for x in self._log() if batches is None or x["batch"] in batches])
        return deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), of("insert"), of("revise"), of("delete"))


def _count_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for piece in small_batches(batch, "text"):
                n = [len(own.ids(x or "")) // 4 for x in piece["text"].to_pylist()]
                yield piece.drop_columns(["text"]).append_column("n_tokens", pa.array(n, pa.int64()))

    return rows


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, source, lang, text) to doc_id, source, lang, n_tokens under a public vocabulary file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_rows(path or default_path()), "doc_id long, source string, lang string, n_tokens long")


def changes(rows: DataFrame, op: str, tokenizer: str, seq: int = 0) -> DataFrame:
    """Rows of documents as changes of one kind."""
    n = F.col("n_tokens") if "n_tokens" in rows.columns else F.lit(0)
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), "doc_id", F.lit(tokenizer).alias("tokenizer"), "source", "lang", n.cast("long").alias("n_tokens"))


def document_totals(docs: DataFrame, tokenizer: str = "byte_bpe_50k/1", path: str | None = None) -> DataFrame:
    """Totals of documents after three batches, the first of them sent twice.

    All documents are inserted; those with repeated lines are revised to what
    they count without the repeats; those of fewer than ten words are deleted.
    loaded_docs and loaded_tokens are the totals after the first batch: those
    of all whole texts.
    """
    spark = docs.sparkSession
    rollup = TokenRollup(spark, shared.fresh_path(spark, "rollup"))
    every = changes(token_counts(docs, path), "insert", tokenizer)
    rollup.commit("1-load", every)
    rollup.commit("1-load", every)
    lines = F.split("text", "\\n")
    revised = docs.withColumn("_lines", lines).where(F.size(F.array_distinct("_lines")) < F.size("_lines")).withColumn("text", F.array_join(F.array_distinct("_lines"), "\n"))
    rollup.commit("2-lines", changes(token_counts(revised, path), "revise", tokenizer))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), ""))
    rollup.commit("3-short", changes(docs.where(words < 10), "delete", tokenizer))
    loaded = rollup.totals(["1-load"]).select(F.struct("source", "lang", "tokenizer").alias("_of"), F.col("n_docs").alias("loaded_docs"), F.col("n_tokens").alias("loaded_tokens"))
    return rollup.totals().join(loaded, F.struct("source", "lang", "tokenizer").eqNullSafe(F.col("_of")), "left").drop("_of")
