"""A treebank derived from `documents` by fixed rules, in Spark and as SQL: every word of every text.

Words are cut at white space; sentences are runs of 12 words. Tags and roles follow from lengths;
even sentences have heads tok_id div 2, odd ones the mirror image.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.storage import scratch_path, stored  # noqa: F401

POS = ["ncn", "vi", "vt", "adj", "adv", "prep", "conj", "npn", "prel", "det", "cl", "pper"]
ROLES = ["subj", "dobj", "pobj", "conj", "modp", "modr", "det", "coord"]
SENTENCE = 12


#: By application, input and name: path and schema of the tables that queries share.
_made: dict = {}


def _version(spark: SparkSession, sf_dir: str) -> str:
    """A name for the state of the documents table: its files, their sizes and times."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    seen = sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in files)
    return hashlib.sha256("\n".join([sf_dir, *seen]).encode()).hexdigest()[:16]


def shared(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What make() gives, stored once for all queries of an application that ask for it on the same state of the input."""
    key = (spark.sparkContext.applicationId, name, _version(spark, sf_dir))
    path, schema = _made.get(key, (None, None))
    if path is not None:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as e:  # the folder was cleared meanwhile
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    out = stored(make(), name)
    _made[key] = (out.stored_at, out.schema)
    return out


def _item(items: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, items)), at + 1)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, words (array of up to 12)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = docs.select("doc_id", F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / SENTENCE)))
    cut = F.transform(starts, lambda k: F.slice(F.col("w"), k.cast("int") * SENTENCE + 1, F.lit(SENTENCE)))
    # exploded as outer: else Spark cuts the text into words once more, to filter by their number
    return words.select("doc_id", F.posexplode_outer(cut).alias("k", "words")).where("k is not null").select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("sent_id"), "words")


def _half(x) -> F.Column:
    return F.call_function("div", x, F.lit(2))


def _tag(word) -> F.Column:
    other = _item(POS, F.char_length(word) % 12)
    return F.when(word.isin(".", ",", "-", ";", ":", "(", ")"), "punc").when(word.rlike("^[0-9]+[.]$"), "nlab").when(word.rlike("^[0-9.,]+$"), "nnum").otherwise(other)


def _head(n, tok_id) -> F.Column:
    back = _half(n + 1 - tok_id)
    return F.when(F.col("sent_id") % 2 == 0, _half(tok_id)).when(back == 0, F.lit(0)).otherwise(n + 1 - back).cast("int")


def _role(word, tok_id, head) -> F.Column:
    return F.when(head == 0, "root").otherwise(_item(ROLES, (F.char_length(word) + tok_id) % 8))


def _pred(tok_id, head) -> F.Column:
    return F.when((F.col("sent_id") * 7 + tok_id * 3) % 5 == 0, tok_id - 1).otherwise(head).cast("int")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, tok_id, n, word, pos, role, head, pred_head."""
    t = sentences(spark, sf_dir).select("sent_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    word, tok_id, head = F.col("word"), F.col("tok_id"), F.col("head")
    t = t.withColumn("tok_id", F.col("p") + 1).withColumn("head", _head(F.col("n"), tok_id)).withColumn("pos", _tag(word))
    return t.select("sent_id", "tok_id", "n", "word", "pos", _role(word, tok_id, head).alias("role"), "head", _pred(tok_id, head).alias("pred_head"))


def rows(spark: SparkSession, sf_dir: str, of=lambda s: s) -> DataFrame:
    """tokens() as a row for each sentence: sent_id and t, its tokens in order. A sentence is one row from the start, so it need not move to become one.
    of: which of the sentences."""
    n = F.size("words")
    t = F.transform("words", lambda w, p: F.struct((p + 1).alias("tok_id"), w.alias("word"), _tag(w).alias("pos"), _head(n, p + 1).alias("head")))
    own = lambda x: [x["tok_id"], x["word"], x["pos"], _role(x["word"], x["tok_id"], x["head"]).alias("role"), x["head"], _pred(x["tok_id"], x["head"]).alias("pred_head")]
    return of(sentences(spark, sf_dir)).select("sent_id", F.transform(t, lambda x: F.struct(*own(x))).alias("t"))


TOK = f"""
w0 AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
w1 AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM w0),
w2 AS (SELECT doc_id * 1000000 + p // {SENTENCE} AS sent_id, (p % {SENTENCE} + 1)::INTEGER AS tok_id,
  least({SENTENCE}, total - (p // {SENTENCE}) * {SENTENCE})::INTEGER AS n, word, length(word) AS l FROM w1),
w3 AS (SELECT *, CASE WHEN word IN ('.', ',', '-', ';', ':', '(', ')') THEN 'punc' WHEN regexp_matches(word, '^[0-9]+[.]$') THEN 'nlab'
  WHEN regexp_matches(word, '^[0-9.,]+$') THEN 'nnum' ELSE {POS!r}[l % 12 + 1] END AS pos,
  (CASE WHEN sent_id % 2 = 0 THEN tok_id // 2 WHEN (n + 1 - tok_id) // 2 = 0 THEN 0 ELSE n + 1 - (n + 1 - tok_id) // 2 END)::INTEGER AS head FROM w2),
tok AS (SELECT sent_id, tok_id, n, word, pos, CASE WHEN head = 0 THEN 'root' ELSE {ROLES!r}[(l + tok_id) % 8 + 1] END AS role, head,
  (CASE WHEN (sent_id * 7 + tok_id * 3) % 5 = 0 THEN tok_id - 1 ELSE head END)::INTEGER AS pred_head FROM w3)"""
