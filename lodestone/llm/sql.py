"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lodestone.llm.chat import _ANY, MARKS, OTHER
from lodestone.llm.quality import BELIEVED, ROUNDS, RULES, SYMBOLS, THRESHOLD

#: Words are what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    shown = f"length(t) + len(regexp_extract_all(t, {_quoted(_ANY)}))"
    marks = " ".join(f"WHEN {_quoted(role)} THEN {sum(map(len, pair))}" for role, pair in MARKS.items())
    other = f"{sum(map(len, OTHER))} + length(r) + len(regexp_extract_all(r, {_quoted(_ANY)}))"
    order = "ORDER BY turn NULLS FIRST, r, t"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
    joined AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' {order}) AS every, coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' {order}), '') AS loss,
    sum({shown} + CASE r {marks} ELSE {other} END) AS chars FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM joined"""


def _embeddings(least: float = 0.98) -> str:
    return f"""WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {least}),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, v.vec_id <= coalesce(c.least, v.vec_id) AS kept
    FROM embeddings v LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = v.vec_id"""


def _quality() -> str:
    """Measures, votes, expectation maximisation over the table of vote patterns as a recursion, and the verdict."""
    tri = lambda x, good, bad: f"CASE WHEN {x} <= {good} THEN 1 WHEN {x} >= {bad} THEN -1 ELSE 0 END"
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"
    length = f"({per('word_chars', 'n_words')})"
    votes = {
        "symbols": tri(f"({per('n_symbols', 'n_words')})", 0.05, 0.2),
        "symbol_runs": tri(f"({per('n_symbol_runs', 'n_words')})", 0.03, 0.1),
        "shouting": tri(f"({per('n_upper', 'n_letters')})", 0.2, 0.5),
        "repeats": tri(f"({per('n_repeat_words', 'n_words')})", 0.2, 0.4),
        "duplicate_lines": tri(f"({per('n_dup_lines', 'n_lines')})", 0.2, 0.5),
        "word_length": f"CASE WHEN {length} BETWEEN 3 AND 11 THEN 1 WHEN {length} < 2 OR {length} > 20 THEN -1 ELSE 0 END",
        "letters": tri(f"(1 - ({per('n_letters', 'word_chars')}))", 0.1, 0.2),
        "marks": tri(f"({per('n_marks', 'n_words')})", 0.1, 0.5),
        "length": "CASE WHEN n_words >= 50 THEN 1 WHEN n_words < 5 THEN -1 ELSE 0 END",
    }
    pairs = [(k, v) for k in range(len(RULES)) for v in (-1, 0, 1)]
    # Lists of 27 chances: rule by rule, for the votes -1, 0 and 1.
    start = [f"[{', '.join(f'{BELIEVED[v][g]}::DOUBLE' for _, v in pairs)}]" for g in (0, 1)]
    odds = "ln(share) - ln(1 - share) + " + " + ".join(f"ln(good[{3 * k + 2} + {r}]) - ln(bad[{3 * k + 2} + {r}])" for k, r in enumerate(RULES))
    p = f"1 / (1 + exp(-greatest(-700.0, least(700.0, {odds}))))"
    seen = [[f"({10 * BELIEVED[v][g]} + coalesce(sum(CASE WHEN {RULES[k]} = {v} THEN {'p' if g == 0 else '(1 - p)'} * n END), 0))" for k, v in pairs] for g in (0, 1)]
    lists = [f"[{', '.join(s)}]" for s in seen]
    normal = lambda name: "[" + ", ".join(f"{name}[{3 * k + 2 + v}] / ({name}[{3 * k + 1}] + {name}[{3 * k + 2}] + {name}[{3 * k + 3}])" for k, v in pairs) + "]"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    return f"""WITH RECURSIVE raw AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    grams AS (SELECT row, unnest(generate_series(1, len(w) - 2)) AS p, w FROM raw WHERE len(w) >= 3), named AS (SELECT row, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM grams),
    twice AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, g) AS c FROM named) WHERE c > 1),
    covered AS (SELECT row, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY row),
    lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS l FROM raw),
    m AS (SELECT raw.row, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars, CAST({count(f'[{SYMBOLS}]')} AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines, {count(chr(92) + 'p{Lu}+')} AS n_upper, {count(chr(92) + 'p{L}+')} AS n_letters,
    {count('[!?]')} AS n_marks, len(regexp_extract_all(t, '[{SYMBOLS}]+')) AS n_symbol_runs FROM raw JOIN lines USING (row) LEFT JOIN covered USING (row)),
    voted AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'{votes[r]} AS {r}' for r in RULES)} FROM m),
    pat AS (SELECT {', '.join(RULES)}, count(*) AS n FROM voted GROUP BY ALL),
    em(k, share, good, bad) AS (SELECT 0, 0.9::DOUBLE, {start[0]}, {start[1]} UNION ALL
    SELECT k + 1, share, {normal('good')}, {normal('bad')} FROM (
    SELECT k, least(greatest(sum(p * n) / sum(n), 1e-6), 1 - 1e-6) AS share, {lists[0]} AS good, {lists[1]} AS bad FROM (SELECT em.k, pat.*, {p} AS p FROM em, pat WHERE em.k < {ROUNDS}) GROUP BY k)),
    model AS (SELECT share, good, bad FROM em ORDER BY k DESC LIMIT 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {THRESHOLD} AS kept FROM voted, model"""


ORACLES = {"op5_chat_format": _chat(), "op6_embedding_dedup": _embeddings(), "op7_quality_rules": _quality()}
