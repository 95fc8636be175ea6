"""The ``opN_<name>`` queries: each operator over its whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontamination import find_leaks
from .divergence import audit
from .exact_dedup import exact_groups
from .license_scan import scan_files
from .lm_score import score_texts
from .merkle import leaf, manifest, tampered_text
from .mixing import mix
from .near_dedup import near_duplicates
from .pii import KINDS, find_pii, fit_pii, span_text
from .registry import QUERIES, SQL, query, table
from .sharding import place
from .substring_dedup import remove_repeats
from .toxicity import fit_toxicity
from .url_filter import Rule, judge_urls

__all__ = ["QUERIES", "SQL"]

SPACE = r"[\x20\x09-\x0D]"

_NEAR_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[ \t\n\x0B\x0C\r]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE []::VARCHAR[] END AS s FROM toks),
ids AS (SELECT doc_id, unnest(s) AS g FROM sets),
cand AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM ids a JOIN ids b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM cand JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN low ON low.x = s.doc_id
"""


@query("op9_odd_sketch_near_dedup", _NEAR_SQL)
def op9(spark, sf_dir):
    """Links at 100 * intersection >= 80 * union of the 2-word shingle sets."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


_REPEATS_SQL = r"""
WITH toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda w: w <> '') AS w FROM documents),
wins AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM toks)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM dup),
lists AS (SELECT doc_id, list(i) AS gone, count(*) AS c FROM gone GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN c IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM toks t LEFT JOIN lists l ON l.doc_id = t.doc_id
"""


@query("op8_rlz_substring_dedup", _REPEATS_SQL)
def op8(spark, sf_dir):
    """Words under 20-word windows that also start earlier are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), length=20).drop("kept_text")


_EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept, sha256(norm) AS text_sha256
FROM n
"""


@query("op6_extendible_hash_exact_dedup", _EXACT_SQL)
def op6(spark, sf_dir):
    """One row per document with the row that stays for its text."""
    return exact_groups(table(spark, sf_dir, "documents"))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query("op5_clause_grammar_toxicity")
def op5(spark, sf_dir):
    """Every document scored; the fifth of the labels named by the id's CRC is never seen."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_string_tiling_decontamination")
def op7(spark, sf_dir):
    """Every document and benchmark item whose tiles cover half of the item or more."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The target shares of the languages' tokens.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def language_mix(docs, sf_dir, weights=LANGUAGE_WEIGHTS):
    """Domains are languages; the documents of the table of labels teach them."""
    known = table(docs.sparkSession, sf_dir, "labels").select("doc_id").distinct().join(
        table(docs.sparkSession, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return mix(docs, known, weights, "lang")


@query("op4_soft_membership_mixing")
def op4(spark, sf_dir):
    """Every document's posterior over the languages, rate and copies for the target weights; with
    the descent's steps and the largest gap that it left between expected and target shares."""
    docs = table(spark, sf_dir, "documents")
    fitted = language_mix(docs, sf_dir)
    return fitted.rates(docs).select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(fitted.model.domains)], "rate", "copies",
                                     F.lit(fitted.report["steps"]).alias("steps"), F.lit(fitted.report["residual"]).alias("residual"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


@query("op2_permutation_table_sharding")
def op2(spark, sf_dir):
    """Every document's slot and shard among 64 shards."""
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), SHARDS)


@query("op3_boosted_candidate_pii")
def op3(spark, sf_dir):
    """Base spans of each kind, and all spans with those that the trees add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, fit_pii(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


@query("op1_host_segmentation_url_filter")
def op1(spark, sf_dir):
    """Every page's url judged by the rules, else by its words."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


@query("op10_tfidf_license_scan")
def op10(spark, sf_dir):
    """Every document as a file of its source's and language's directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_files(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


_MERKLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
crc_table(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM crc_table WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c & 255, b)) + 1]::BIGINT)), 4294967295) AS v FROM (SELECT DISTINCT doc_id FROM documents), tab),
leaves AS (
  SELECT d.doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN v % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS now
  FROM docs d JOIN crc ON crc.doc_id = d.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM placed
  UNION ALL SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, lvl, pos // 16, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subs
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
sib AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY 1, 2, 3),
topsib AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY 1, 2),
path AS (
  SELECT p.source, p.pos, s.lvl, s.l, s.r FROM placed p JOIN sib s ON s.source IS NOT DISTINCT FROM p.source AND s.pos = p.pos // pow(16, s.lvl)::BIGINT
  UNION ALL SELECT p.source, p.pos, 1000 + t.lvl, t.l, t.r FROM placed p JOIN subs u ON u.source IS NOT DISTINCT FROM p.source
  JOIN topsib t ON t.pos = u.pos // pow(16, t.lvl)::BIGINT),
proofs AS (SELECT source, pos, list(l ORDER BY lvl) AS ls, list(r ORDER BY lvl) AS rs, string_agg(l || r, '' ORDER BY lvl) AS proof FROM path GROUP BY 1, 2),
done AS (
  SELECT p.doc_id, p.leaf, u.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(now, list_transform(range(1, coalesce(len(ls), 0) + 1), lambda i: ls[i] || '|' || rs[i])),
                     lambda d, s: sha256(string_split(s, '|')[1] || d || string_split(s, '|')[2])) AS folded_root
  FROM placed p JOIN subs u ON u.source IS NOT DISTINCT FROM p.source
  LEFT JOIN proofs f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


@query("op12_butterfly_merkle_manifest", _MERKLE_SQL)
def op12(spark, sf_dir):
    """Every document as a leaf with its proof; one in five is checked with lower-cased text."""
    docs = table(spark, sf_dir, "documents")
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*head, tampered_text(text)))
    return manifest(docs, "doc_id", "source", leaf(*head, text), changed).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
uses AS (SELECT r, lang, source, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM uses GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
used AS (SELECT lang, source, term, count(*) AS c FROM uses SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN used USING (lang, source) GROUP BY 1, 2),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 1)) // (g.n + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM share WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""


@query("op13_cube_source_divergence", _AUDIT_SQL)
def op13(spark, sf_dir):
    """Every source against the others of its language, and the terms it has more of."""
    return audit(table(spark, sf_dir, "documents"))


@query("op11_subword_lattice_lm")
def op11(spark, sf_dir):
    """Every document scored; those whose CRC leaves 2 modulo 7 do not teach."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
