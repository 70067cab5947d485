"""Token counts by source, language and tokenizer version, kept up by deltas.

The folder of a rollup has one sub-folder per batch in two tables: ``ledger``
(signed counts per document) and ``totals`` (their sums per group).  Counts are
additive, so the state of a document is the sum of its ledger rows and a total
is the sum over batches.  A delete or revision subtracts what the ledger holds
for the document and adds the new count.

A batch id is committed once: its parts lie under a folder named by the id,
are overwritten by a repeated attempt, and count only when the marker file,
written last, exists.  Replaying a committed batch changes nothing.

Defined results: a null text counts zero tokens; null source or language is a
group of its own; several rows of one document in a batch are all added (repeated
inserts add up); a delete or revision removes all that earlier batches hold for
the document, also if that is nothing; an empty batch commits and adds nothing.
A null doc_id is a document like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import bound_batches, documents, in_blocks, words_of
from matloom.llm.registry import query
from matloom.llm.tokens import tokenizer
from matloom.runtime import Workspace

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


class TokenRollup:
    """A rollup in ``folder`` on storage that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    # -- commit log ----------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of committed batches; one small file each."""
        log = self._path("commits")
        if not self._fs().exists(log):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(log))

    def _read(self, table: str, schema: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{table}/{b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # -- changes -------------------------------------------------------------

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit ``(op, doc_id, source, lang, tokenizer, tokens)`` rows once.

        ``op`` is insert, delete or revise; a delete or revision concerns the
        count of its document under its tokenizer.  Returns False when the batch
        was committed before.
        """
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        done = self.committed()
        if batch_id in done:
            return False
        added = changes.where(F.col("op") != DELETE).select(
            "doc_id", *GROUP, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")
        )
        # Sums first: a document may have many ledger rows or many changes.
        gone = changes.where(F.col("op") != INSERT).select(F.col("doc_id").alias("_doc"), F.col("tokenizer").alias("_kind")).distinct()
        held = self._read("ledger", LEDGER, done)
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("tokenizer").eqNullSafe(F.col("_kind"))
        undone = held.join(gone, same, "left_semi").groupBy("doc_id", *GROUP).agg(F.sum(-F.col("docs")).alias("docs"), F.sum(-F.col("tokens")).alias("tokens"))
        signed = added.unionByName(undone).where("docs != 0 OR tokens != 0")
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch_id}")
        (
            self._read("ledger", LEDGER, [batch_id])
            .groupBy(*GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .write.mode("overwrite")
            .parquet(f"{self.folder}/totals/{batch_id}")
        )
        self._fs().create(self._path("commits", batch_id), True).close()
        return True

    def totals(self) -> DataFrame:
        """Current sums; groups whose documents have all gone are left out."""
        sums = self._read("totals", TOTALS, self.committed()).groupBy(*GROUP)
        return sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")


# -- counting -----------------------------------------------------------------


def count_vocabulary(docs: DataFrame, version: str = "word_bpe_49k", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)`` under a public vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in in_blocks(batches):
            n = [len(coder.encode(t.as_py())) // 4 for t in batch.column("text").cast(pa.large_binary())]
            columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    bound_batches(docs)
    counted = docs.select("doc_id", "source", "lang", "text").mapInArrow(
        count, "doc_id long, source string, lang string, tokens long"
    )
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens")


def count_words(docs: DataFrame, version: str = "words_1") -> DataFrame:
    """The same for white-space separated words."""
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"))


@query("op8_token_rollup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions, then a second
    version of the word rule revises every count of a non-English document and
    withdraws documents marked toxic; that batch is delivered twice."""
    ws = Workspace(spark, file_factor=1)
    rollup = TokenRollup(spark, ws.new_path("rollup"))
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = count_vocabulary(docs).unionByName(count_words(docs))
    rollup.apply("load", both.withColumn("op", F.lit(INSERT)))
    revised = docs.where("lang != 'en'").withColumn("text", F.translate("text", "'-", "  "))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    kept = count_words(revised).join(toxic, "doc_id", "left_anti").withColumn("op", F.lit(REVISE))
    kinds = F.explode(F.array(F.lit("word_bpe_49k"), F.lit("words_1")))
    gone = docs.join(toxic, "doc_id", "left_semi").select("doc_id", "source", "lang", kinds.alias("tokenizer"), F.lit(0).cast("long").alias("tokens"), F.lit(DELETE).alias("op"))
    for _ in range(2):
        rollup.apply("revise", kept.unionByName(gone))
    return rollup.totals()
