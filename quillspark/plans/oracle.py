"""DuckDB SQL for the named queries, written for itself: other regular expressions (RE2 has no lookahead), training as one step of common table expressions for each merge."""

from __future__ import annotations

from quillspark.functions.whitespace import SPACER, WS25_CLASS, WS29_CLASS

GPT2 = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS25_CLASS}\x{{1}}\p{{L}}\p{{N}}]+|[{WS25_CLASS}]+"
OPEN, CLOSE = "chr(1)", "chr(2)"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{WS29_CLASS}]+')"


def gpt2(text: str) -> str:
    """Chunks; before the last white character of a run comes a mark that no chunk takes in."""
    quoted = GPT2.replace("'", "''")
    marked = f"regexp_replace({text}, '([{WS25_CLASS}]+)([{WS25_CLASS}][^{WS25_CLASS}])', '\\1' || chr(1) || '\\2', 'g')"
    return f"CASE WHEN {text} = '' THEN [''] ELSE regexp_extract_all({marked}, '{quoted}') END"


def prefixed(chunk: str) -> str:
    return f"CASE WHEN {chunk} = '' THEN '' ELSE '{SPACER}' || regexp_replace(nfc_normalize({chunk}), '[{WS25_CLASS}]+', '{SPACER}', 'g') END"


#: Chunks of all documents and their normal form.
CHUNKS = f"""c0 AS (SELECT doc_id, lang, {gpt2('text')} AS chunks FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, lang, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS pos FROM c0),
ch AS (SELECT doc_id, lang, pos, chunk, {prefixed('chunk')} AS word FROM c1)"""

_CHARS = "regexp_extract_all(word, '(?s).')"
_BYTES = "['<0x' || x || '>' for x in regexp_extract_all(hex(encode(word)), '..')]"


def _marked(tokens: str) -> str:
    return f"{OPEN} || array_to_string({tokens}, {CLOSE} || {OPEN}) || {CLOSE}"


def trained(merges: int, *, tokens: str = _CHARS, ties: str = "f", valid: str = f"len(l || r) <= 16 AND NOT contains(substr(l || r, 2), '{SPACER}')") -> str:
    """CHUNKS, words w0, then for each merge the pair p{i} and the words w{i+1} after it."""
    out = [CHUNKS, f"w0 AS MATERIALIZED (SELECT word, min(struct_pack(d := doc_id, p := pos)) AS ord, count(*) AS n, {_marked(tokens)} AS s FROM ch WHERE word <> '' GROUP BY word)"]
    for i in range(merges):
        out.append(
            f"""p{i} AS MATERIALIZED (SELECT l, r, c FROM (SELECT t[k] AS l, t[k + 1] AS r, sum(n) AS c, min(struct_pack(o := ord, k := k)) AS f FROM (
 SELECT ord, n, t, unnest(range(1, len(t))) AS k FROM (SELECT ord, n, string_split(substr(s, 2, len(s) - 2), {CLOSE} || {OPEN}) AS t FROM w{i})) GROUP BY 1, 2) WHERE {valid} ORDER BY c DESC, {'f' if ties == 'f' else 'l, r'} LIMIT 1)"""
        )
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT word, ord, n, replace(s, {OPEN} || l || {CLOSE} || {OPEN} || r || {CLOSE}, {OPEN} || l || r || {CLOSE}) AS s FROM w{i}, p{i})")
    return ",\n".join(out)


def merges_of(merges: int) -> str:
    return " UNION ALL ".join(f"SELECT {i}::INT AS rank, l AS \"left\", r AS \"right\" FROM p{i}" for i in range(merges))


def encoded(merges: int) -> str:
    """CTEs up to enc(doc_id, lang, pos, tokens): every chunk as the words after the last merge have it."""
    return f"{trained(merges)},\nseg AS MATERIALIZED (SELECT word, string_split(substr(s, 2, len(s) - 2), {CLOSE} || {OPEN}) AS tokens FROM w{merges}),\nenc AS (SELECT ch.doc_id, ch.lang, ch.pos, tokens FROM ch JOIN seg USING (word))"


def token_rows(merges: int) -> str:
    """CTEs up to tok(doc_id, lang, pos, k, token)."""
    return f"{encoded(merges)},\ntok AS (SELECT doc_id, lang, pos, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM enc)"


def report(merges: int) -> str:
    """CTEs up to rep(lang, n_tokens, n_words, n_chars, fertility, compression)."""
    return f"""{encoded(merges)},
tc AS (SELECT lang, sum(len(tokens))::BIGINT AS n_tokens FROM enc GROUP BY lang),
wc AS (SELECT lang, sum(len({words('text')}))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang),
rep AS (SELECT lang, n_tokens, n_words, n_chars, CASE WHEN n_words = 0 THEN 0 ELSE n_tokens / n_words::DOUBLE END AS fertility, CASE WHEN n_chars = 0 THEN 0 ELSE n_tokens / n_chars::DOUBLE END AS compression FROM tc JOIN wc USING (lang))"""


def fair(merges: int, weight: float, langs: list[str]) -> str:
    """Training by language: fertilities f{i} and pairs p{i} of the greatest weighted count."""
    ord_of = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(langs)) + " END"
    out = [CHUNKS, f"w0 AS MATERIALIZED (SELECT lang, word, min(struct_pack(g := {ord_of}, d := doc_id, p := pos)) AS ord, count(*) AS n, {_marked(_BYTES)} AS s FROM ch WHERE lang IN {sql_list(langs)} GROUP BY lang, word)"]
    split = f"string_split(substr(s, 2, len(s) - 2), {CLOSE} || {OPEN})"
    for i in range(merges):
        out.append(f"f{i} AS MATERIALIZED (SELECT " + ", ".join(f"sum(CASE WHEN lang = '{x}' THEN n * len({split}) END)::DOUBLE / sum(CASE WHEN lang = '{x}' THEN n END) AS f_{x}" for x in langs) + f" FROM w{i})")
        total = " + ".join(["0.0::DOUBLE", *(f"c_{x} * pow(f_{x}, {weight})" for x in langs)]) if weight else "c"
        out.append(
            f"p{i} AS MATERIALIZED (SELECT l, r FROM (SELECT t[k] AS l, t[k + 1] AS r, sum(n) AS c, min(struct_pack(o := ord, k := k)) AS f, "
            + ", ".join(f"sum(CASE WHEN lang = '{x}' THEN n ELSE 0 END)::DOUBLE AS c_{x}" for x in langs)
            + f" FROM (SELECT lang, ord, n, t, unnest(range(1, len(t))) AS k FROM (SELECT lang, ord, n, {split} AS t FROM w{i})) GROUP BY 1, 2), f{i} ORDER BY {total} DESC, f LIMIT 1)"
        )
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT lang, word, ord, n, replace(s, {OPEN} || l || {CLOSE} || {OPEN} || r || {CLOSE}, {OPEN} || l || r || {CLOSE}) AS s FROM w{i}, p{i})")
    return ",\n".join(out)


BYTES = _BYTES


def vocabulary(merges: int) -> str:
    """CTE voc(id, token) after trained(merges)."""
    return f"""base AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS token FROM w0), allt AS (SELECT token, 0 AS part, 0 AS q FROM base UNION ALL SELECT "left" || "right", 1, rank FROM ({merges_of(merges)})), voc AS (SELECT (row_number() OVER (ORDER BY part, q, encode(token)) - 1)::INT AS id, token FROM allt)"""


def json_string(text: str) -> str:
    """A text as a JSON string of ASCII."""
    u = "unicode(c)"
    pair = f"'\\u' || format('{{:04x}}', 55296 + ({u} - 65536) // 1024) || '\\u' || format('{{:04x}}', 56320 + ({u} - 65536) % 1024)"
    named = " ".join(f"WHEN {ord(c)} THEN '{e}'" for c, e in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")))
    one = f"CASE {u} {named} ELSE CASE WHEN {u} BETWEEN 32 AND 126 THEN c WHEN {u} < 65536 THEN '\\u' || format('{{:04x}}', {u}) ELSE {pair} END END"
    return f"('\"' || list_aggregate([{one} FOR c IN regexp_extract_all({text}, '(?s).')], 'string_agg', '') || '\"')"


def hashed(merges: int, algorithm: str, version: str, normalizer: str) -> str:
    """SHA-256 of the model's canonical JSON, its size and number of merges."""
    m = f"""(SELECT string_agg('[' || {json_string('"left"')} || ', ' || {json_string('"right"')} || ']', ', ' ORDER BY rank) FROM ({merges_of(merges)}))"""
    v = f"(SELECT string_agg({json_string('token')}, ', ' ORDER BY id) FROM voc)"
    head = f"'{{\"algorithm\": \"{algorithm}\", \"byte_fallback\": true, \"merges\": {{\"merges\": ['"
    middle = f"']}}, \"normalizer\": {normalizer}, \"version\": \"{version}\", \"vocab\": {{\"byte_fallback\": true, \"tokens\": ['"
    return f"WITH {trained(merges)}, {vocabulary(merges)} SELECT sha256({head} || {m} || {middle} || {v} || '], \"use_special_tokens\": false}}}}') AS model_hash, (SELECT count(*) FROM voc) AS vocab_size, {merges}::BIGINT AS num_merges"


def explained(merges: int) -> str:
    """Every merge of every item of the benchmark: the leftmost of the lowest rank, one at a time."""
    return f"""WITH RECURSIVE {trained(merges)}, {vocabulary(merges)},
vl AS MATERIALIZED (SELECT list(token) AS known FROM voc),
mm AS MATERIALIZED (SELECT list("left" || chr(1) || "right" ORDER BY rank) AS keys FROM ({merges_of(merges)})),
b0 AS (SELECT item_id, {gpt2('text')} AS chunks FROM benchmark),
b1 AS (SELECT item_id, unnest(chunks) AS chunk, (generate_subscripts(chunks, 1) - 1)::INT AS number FROM b0),
b2 AS (SELECT item_id, number, regexp_extract_all({prefixed('chunk')}, '(?s).') AS chars FROM b1),
b3 AS (SELECT item_id, number, flatten([CASE WHEN list_contains(known, c) THEN [c] ELSE ['<0x' || x || '>' FOR x IN regexp_extract_all(hex(encode(c)), '..')] END FOR c IN chars]) AS t FROM b2, vl),
st AS (SELECT item_id, number, 0 AS step, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::INT AS rank, t FROM b3
 UNION ALL SELECT item_id, number, step + 1, t[k], t[k + 1], rk, list_concat(list_concat(t[:k - 1], [t[k] || t[k + 1]]), t[k + 2:]) FROM (
  SELECT *, list_position(x, rk) AS k FROM (SELECT *, list_min(x) AS rk FROM (SELECT st.*, [nullif(coalesce(list_position(keys, t[i] || chr(1) || t[i + 1]), 0), 0) - 1 FOR i IN range(1, len(t))]::INT[] AS x FROM st, mm)) WHERE rk IS NOT NULL))
SELECT item_id, number AS chunk, step, coalesce(l, '') AS "left", coalesce(r, '') AS "right", coalesce(rank, -1)::INT AS rank, array_to_string(t, ' ') AS tokens FROM st"""


def sweep(merges: int, weights: tuple[float, ...], langs: list[str]) -> str:
    """Fertilities by language after training with each weight."""
    count = f"len(string_split(substr(s, 2, len(s) - 2), {CLOSE} || {OPEN}))"
    one = lambda w: f"SELECT * FROM (WITH {fair(merges, w, langs)} SELECT {float(w)}::DOUBLE AS fairness_weight, lang, sum(n * {count}) / sum(n)::DOUBLE AS fertility FROM w{merges} GROUP BY lang)"
    return f"SELECT *, max(fertility) OVER (PARTITION BY fairness_weight) - min(fertility) OVER (PARTITION BY fairness_weight) AS fertility_gap FROM ({' UNION ALL '.join(map(one, weights))})"


def generated(languages: list[tuple[str, list[str], list[str]]], sentences: int) -> str:
    """Sentences by arithmetic over stems and endings."""
    texts = lambda ws: "[" + ", ".join("'" + w + "'" for w in ws) + "]"
    rows = ", ".join(f"('{name}', {k}, {texts(stems)}, {texts(ends)})" for k, (name, stems, ends) in enumerate(languages))
    return f"SELECT lang, lang_ord::INT AS lang_ord, (lang_ord * {sentences} + i)::BIGINT AS doc_id, array_to_string([stems[(i * j + j) % len(stems) + 1] || ends[(i + 3 * j) % len(ends) + 1] FOR j IN range(0, 5 + i % 6)], ' ') AS text FROM (VALUES {rows}) t(lang, lang_ord, stems, ends), range({sentences}) r(i)"
