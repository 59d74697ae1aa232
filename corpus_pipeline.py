"""The training-data pipeline: documents pass every stage, each written as Parquet and reread.

Stages take (spark, docs, sf_dir).  All but the last return the columns of their input; where a text
was changed, ``n_chars`` (if there is such a column) is its new length.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from motes.llm import minhash, packing, personal, run_index, toxicity
from motes.llm.common import discard, recorded, reserved, written

#: A document scored at least this toxic is rejected.
TOXIC = 0.3
#: Repeats of this many bytes are removed; fifty words of prose are longer.
REPEAT = 200
#: Bytes of encoded words a worker of the last stage remembers; it still holds memory of the stages before.
PIECES = 128_000_000


#: Intermediate tables of the stage that ran last.
_made: list[str] = []


def stage(make):
    """A stage that first deletes the intermediate tables of the one before, whose result is written by now."""
    @wraps(make)
    def run_stage(spark, docs, sf_dir):
        discard(spark, _made)
        with recorded(_made):
            return make(spark, docs, sf_dir)
    return run_stage


def _measured(docs):
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


@stage
def clean(spark, docs, sf_dir):
    """Documents that are not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = reserved(docs.columns, "toxic_score")
    return toxicity.scores(docs, labels, score=score).where(F.col(score) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def distinct(spark, docs, sf_dir):
    """One document of each group of near-duplicates; of rows alike in id and text one stays."""
    kept = minhash.near_duplicates(docs, size=5, threshold=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


@stage
def unrepeated(spark, docs, sf_dir):
    """Documents without the byte strings that occur more than once among them."""
    return _measured(run_index.without_repeats(docs, REPEAT, (32, REPEAT - 31, REPEAT), text=True))


@stage
def private(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind."""
    return _measured(personal.redacted(docs))


@stage
def packed(spark, docs, sf_dir):
    """Pieces of documents in token sequences of balanced cost."""
    return packing.pack(docs, memory=PIECES)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("repeats", unrepeated), ("personal_data", private), ("packing", packed)]

#: Trained scores, byte-level repeats and library tokens have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = written(step(spark, docs, sf_dir))
    return docs
