"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, codes, fingerprint, jaccard, langid, packing, phrases, pii, repeats, secrets, tokens, toxicity
from .common import documents

QUERIES = {
    "op1_secret_scan": lambda spark, d: secrets.report(documents(spark, d)),
    "op2_language_id": lambda spark, d: langid.report(documents(spark, d)),
    "op3_ngram_jaccard": lambda spark, d: jaccard.report(documents(spark, d)),
    "op4_document_fingerprint": lambda spark, d: fingerprint.report(documents(spark, d)),
    "op5_nearest_neighbours": lambda spark, d: ann.report(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op6_suffix_array_dedup": lambda spark, d: repeats.report(documents(spark, d)),
    "op7_pii": lambda spark, d: pii.report(documents(spark, d)),
    "op8_best_fit_packing": lambda spark, d: packing.pack(documents(spark, d)),
    "op9_toxicity": lambda spark, d: toxicity.report(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "pipeline": corpus_pipeline.run,
    "op10_bpe_encode_decode": lambda spark, d: bpe.digests(documents(spark, d)),
    "op11_phrase_collocations": lambda spark, d: phrases.report(documents(spark, d)),
    "op12_token_counts": lambda spark, d: tokens.report(documents(spark, d)),
    "op13_vector_codes": lambda spark, d: codes.report(spark.read.parquet(f"{d}/embeddings.parquet")),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1 : c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[c.k + 1 :], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(s[i : i + q - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM cand)) GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inside i USING (lang, phrase) WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * l.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000"""

_floor = lambda x, n: f"({x} - ((({x}) % {n} + {n}) % {n})) // {n}"
_near = lambda b: f"SELECT id, p, any_value(q.a) AS a, any_value(q.b) AS b, any_value(q.c) AS c, any_value(q.d) AS d, min(((q.a - e.a) ** 2 + (q.b - e.b) ** 2 + (q.c - e.c) ** 2 + (q.d - e.d) ** 2)::BIGINT * 64 + e.i) AS best FROM q JOIN {b} e USING (p) GROUP BY id, p"
_sums = "SELECT p, best % 64 AS i, count(*) AS n, " + ", ".join(f"sum({x})::BIGINT AS {x}" for x in "abcd") + " FROM {} GROUP BY ALL"
_moved = lambda b, n: f"SELECT o.p, o.i, " + ", ".join(f"CASE WHEN s.n IS NULL THEN o.{x} ELSE {_floor(f's.{x}', 's.n')} END AS {x}" for x in "abcd") + f" FROM {b} o LEFT JOIN ({_sums.format(n)}) s USING (p, i)"  # noqa: E731, F541
#: For the given vectors, of 64 components.
CODES = f"""WITH v AS (SELECT row_number() OVER () AS id, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT id, vec_id, e, p, {", ".join(f"floor(256 * e[4 * p + {i + 1}]::DOUBLE)::BIGINT AS {x}" for i, x in enumerate("abcd"))} FROM v CROSS JOIN (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, i, a, b, c, d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id, e) - 1 AS i FROM q) WHERE i < 64),
n0 AS ({_near("b0")}), b1 AS ({_moved("b0", "n0")}), n1 AS ({_near("b1")}), b2 AS ({_moved("b1", "n1")}), n2 AS ({_near("b2")}),
o AS (SELECT id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM n2 GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, i)) FROM b2) AS codebooks_sha256 FROM o JOIN v USING (id)"""

#: Tokenizers, trained models and searches of candidates stand in the way of SQL for the others.
ORACLE: dict[str, str] = {"op11_phrase_collocations": PHRASES, "op13_vector_codes": CODES}
