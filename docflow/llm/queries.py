"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import (
    compact_windows,
    decontamination,
    exact_dedup,
    lexical_search,
    licenses,
    mixing,
    ngram_join,
    phrases,
    secret_scan,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
)
from docflow.session import materialize, new_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_compact_windows(spark, folder):
    """Passages of 50 words and more that an earlier document has, near equal."""
    return compact_windows.near_duplicate_passages(table(spark, folder, "documents"))


def op2_toxicity(spark, folder):
    """Toxicity of every text; fold 2 of the labels is never learnt from."""
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id",
        F.coalesce(toxicity.fold() == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )


def op3_license_scan(spark, folder):
    """Licence phrases and notices in every text."""
    return licenses.scan(table(spark, folder, "documents"))


def op4_mixing(spark, folder):
    """Sources mixed to their weights."""
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "part"
    )


def op5_sharding(spark, folder):
    """Documents in 24 shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, folder, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_token_counts(spark, folder, tokenizers=token_counts.TOKENIZER_FOLDER):
    """Token totals after three batches: all documents come, the later rows of
    equal texts go, and what is not English is counted anew by another version."""
    docs = table(spark, folder, "documents")
    first, second = (token_counts.tokens(f"{tokenizers}/{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    other = F.col("lang") != "en"
    counts = materialize(
        docs.select(
            "doc_id",
            "source",
            "lang",
            F.sha2("text", 256).alias("_digest"),
            first("text").alias("tokens"),
            second(F.when(other, F.col("text"))).alias("_anew"),
        ),
        "counts",
    ).withColumn("version", F.lit("byte_bpe_50k"))
    stay = counts.groupBy("_digest").agg(F.min("doc_id").alias("_stays"))
    ledger = materialize(
        counts.join(stay, "_digest", "left").withColumn(
            "_gone", F.coalesce(F.col("doc_id") != F.col("_stays"), F.lit(False))
        ),
        "ledger",
    )
    rollup = token_counts.Rollup(spark, new_folder(spark, "rollup"))
    rollup.commit(1, token_counts.inserted(counts))
    rollup.commit(2, token_counts.deleted(ledger.filter("_gone")))
    recounted = ledger.filter(other & ~F.col("_gone"))
    anew = recounted.select("source", "lang", F.lit("byte_bpe_multi_50k").alias("version"), F.col("_anew").alias("tokens"))
    rollup.commit(3, token_counts.revised(recounted, anew))
    return rollup.totals()


def op7_suffix_dedup(spark, folder):
    """Bytes of strings of 50 bytes that an earlier document has, taken out."""
    return suffix_dedup.remove_repeated(table(spark, folder, "documents"))


def op8_ngram_join(spark, folder):
    """Components of documents whose shingle sets are near equal."""
    return ngram_join.jaccard_components(table(spark, folder, "documents"), 80)


def op9_decontamination(spark, folder):
    """Benchmark items found in documents, with their edit distance."""
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_exact_dedup(spark, folder):
    """Rows of equal text, and the one that stays."""
    return exact_dedup.exact_dedup(spark, f"{folder}/documents.parquet")


def op11_lexical_search(spark, folder):
    """The 50 best documents of every benchmark item."""
    index = lexical_search.build(table(spark, folder, "documents"))
    return lexical_search.search(index, table(spark, folder, "benchmark"))


def op12_phrases(spark, folder):
    """The best collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op13_secret_scan(spark, folder):
    """Secrets by pattern and by the Markov models of a labelled sample, in every text."""
    docs = table(spark, folder, "documents")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_tokens(docs)))

    def of(kind: str):
        return F.filter("found", lambda x: x["kind"] == kind)

    base = F.filter("found", lambda x: x["kind"] != "markov")
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


def all_queries() -> dict[str, Query]:
    return {
        name: function
        for name, function in sorted(globals().items())
        if name.startswith("op") and callable(function)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": OP4,
        "op8_ngram_join": OP8,
        "op10_exact_dedup": OP10,
        "op11_lexical_search": OP11,
        "op12_phrases": OP12,
    }


OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

OP10 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k"""

# Clamps by closed form: sources in order of the level at which they reach
# three times their size; the first prefix that leaves the others unclamped.
OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total,
  coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE AS taken,
  sum(weight) OVER (ORDER BY 3 * source_size / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS rest
  FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - taken) / rest, taken) FILTER ((total - taken) / rest <= 3 * source_size / weight) AS level FROM c),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.copies,
  CAST(round(r.target - r.copies * r.source_size) AS BIGINT)
  - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies, CAST(greatest(0, least(size, rest)) AS BIGINT) AS part,
  CAST(copies * size + greatest(0, least(size, rest)) AS BIGINT) AS taken FROM p"""

OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY doc_id, term),
g AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
v AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT v.term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM v, g),
s AS (SELECT q.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (100 - 50 + (50 * f.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w ON w.term = q.term JOIN f ON f.term = q.term, g GROUP BY q.item_id, f.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
q AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 100),
s AS (SELECT q.lang, q.phrase, q.f AS a, x.f AS l, y.f AS r, t.n, j,
    CAST((1000::HUGEINT * q.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM q) q
  JOIN c x ON x.lang = q.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN c y ON y.lang = q.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
  JOIN t ON t.lang = q.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT DISTINCT u.lang, u.phrase FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, k),
    lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM q) u
  JOIN q v ON v.lang = u.lang AND v.phrase = u.phrase AND u.f >= v.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN o USING (lang, phrase) QUALIFY rank <= 2000"""
