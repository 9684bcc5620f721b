"""Queries op1 to op13 over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document takes an insertion, a replacement and a deletion at places that its id and length give."""
    from .tokens import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    place = lambda k: F.pmod(F.crc32(F.concat_ws(":", F.col("doc_id"), F.lit(k)).cast("binary")), size + 1)
    edit = lambda k, remove, insert: F.struct(place(k).alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(edit(1, 0, " a new sentence, put in here."), edit(2, 12, "changed"), edit(3, 40, ""))
    return count_tokens(docs.withColumn("edits", edits))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), text=False).drop("kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify

    docs = identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(_table(spark, sf_dir, "pages")), payload=False).drop("payload")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    kept = judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transducer import encode_texts

    return encode_texts(_table(spark, sf_dir, "documents"), ids=False, decoded=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claimed texts are in small letters where 5 divides the crc32 of doc_id."""
    from .merkle import manifest

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(_table(spark, sf_dir, "documents"), F.when(tampered, lower).otherwise(F.col("text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_bpe_transducer": op11_bpe_transducer,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB has no CRC-32: its table, from the polynomial, and the number of a string's bytes
_CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(s: str) -> str:
    """SQL for the unsigned CRC-32 of a string that isn't empty, where the table's column t is at hand."""
    data = f"list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _lower(s: str) -> str:
    return f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle_sql() -> str:
    """Every level of the tree as a step: nodes, their number, and what is left and right of each in its run."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    steps = [
        f"tab AS ({_CRC_TABLE})",
        f"docs AS (SELECT doc_id, coalesce(':' || source, '-') AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(_lower('text'))} ELSE {leaf('text')} END AS claimed FROM documents, tab)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)",
    ]

    def levels(name: str, start: str, most: int) -> None:
        steps.append(f"{name}_0 AS ({start})")
        for k in range(most):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            steps.append(f"""{name}{k} AS MATERIALIZED (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS n,
                coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})""")
            steps.append(f"{name}_{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY tree, i // 16)")

    levels("s", "SELECT tree, pos AS i, leaf AS d FROM leaves", 7)
    steps.append("sub AS MATERIALIZED (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM s_7)")
    levels("u", "SELECT 'all' AS tree, place AS i, subroot AS d FROM sub", 4)
    step = "f0 AS (SELECT doc_id, leaf, claimed AS f, '' AS proof, pos, tree, subroot, place FROM leaves JOIN sub USING (tree))"
    steps.append(step)
    for k, (name, size, at, tree) in enumerate([("s", 16**k, "pos", "x.tree = f.tree") for k in range(7)] + [("u", 16**k, "place", "true") for k in range(4)]):
        level = k if name == "s" else k - 7
        steps.append(f"""f{k + 1} AS (SELECT doc_id, leaf, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof, pos, f.tree AS tree, subroot, place
            FROM f{k} f JOIN {name}{level} x ON {tree} AND x.i = {at} // {size})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM f11, u_4"

ORACLE: dict[str, str] = {
    "op3_warc": r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS latest,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, (k // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1) FOR k IN range(32)], '') AS digest
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to,
       '<urn:page:' || CAST(page_id AS VARCHAR) || ':' || digest || '>' AS record_id, url AS target_uri
FROM t
""",
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i, w FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM s
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE least < doc_id
), x AS (
  SELECT doc_id, count(*) AS n, list(j) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE
         [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
""",
    "op7_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bs
), ns AS (
  SELECT DISTINCT n FROM bw
), ds AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n
), m AS (
  SELECT ds.doc_id, ds.i, ds.n, bw.item_id FROM ds JOIN bw ON ds.n = bw.n AND array_to_string(ds.w[ds.i:ds.i + ds.n - 1], ' ') = bw.win
), h AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_lower("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), k AS (
  SELECT id, run, {_crc32("id || ':' || run")} AS h FROM (SELECT DISTINCT id, run FROM r), tab
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM r JOIN k USING (id, run)
), v AS MATERIALIZED (
  SELECT word, count(*) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
), d AS MATERIALIZED (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)
), g AS MATERIALIZED (
  SELECT DISTINCT d.word AS a, d.n AS an, v.word AS b, v.n AS bn FROM d JOIN v ON d.rest = v.word
), e AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM g UNION ALL SELECT b, a, an FROM g
), s AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM e GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word AS word, v.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN s ON v.word = s.word
), t AS (
  SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word AS word, n, n_near, form, form_n, x.root AS root FROM f JOIN (SELECT t.word AS word, t.root AS root FROM t JOIN f ON t.root = f.word WHERE f.form IS NULL) x ON f.word = x.word
""",
    "op13_merkle_manifest": _merkle_sql(),
}
