"""SQL pieces for the twins of the registered queries; they say the same as the Column builders, in DuckDB's words."""

from __future__ import annotations

from ..functions import language
from ..functions.patterns import PII, SECRETS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(text: str, pattern: str, entity_type: str, score: float = 1.0) -> str:
    """A list of structs (s, e, t, p): all matches of the pattern with offsets."""
    p = quoted(pattern)
    return (
        f"list_transform(range(1, len(regexp_extract_all({text}, {p})) + 1), lambda i: {{"
        f"'s': CAST(coalesce(list_sum(list_transform(string_split_regex({text}, {p})[1:i], lambda x: length(x))), 0)"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({text}, {p})[1:i-1], lambda x: length(x))), 0) AS INTEGER),"
        f" 'e': CAST(coalesce(list_sum(list_transform(string_split_regex({text}, {p})[1:i], lambda x: length(x))), 0)"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({text}, {p})[1:i], lambda x: length(x))), 0) AS INTEGER),"
        f" 't': {quoted(entity_type)}, 'p': CAST({score} AS DOUBLE)}})"
    )


def secret_hits(text: str, types: list[str]) -> str:
    return "list_concat(" + ", ".join(hits(text, p, t) for t in types for p in SECRETS[t]) + ", [])"


APART = "(h.s = 0 OR NOT regexp_matches(substr({text}, h.s, 1), '[0-9A-Za-z]')) AND NOT regexp_matches(substr({text}, h.e + 1, 1), '[0-9A-Za-z]')"
DIGITS = "regexp_replace(substr({text}, h.s + 1, h.e - h.s), '[^0-9]', '', 'g')"
LUHN = (
    "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1"
    " THEN CASE WHEN 2 * CAST(substr({d}, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr({d}, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({d}, i, 1) AS INTEGER) END"
    " ELSE CAST(substr({d}, i, 1) AS INTEGER) END)) % 10 = 0"
)


def pii_hits(text: str, types: list[str]) -> str:
    parts = []
    for t in types:
        raw = hits(text, PII[t], t)
        if t == "IP_ADDRESS":
            raw = f"list_filter({raw}, lambda h: {APART.format(text=text)})"
        if t == "CREDIT_CARD":
            d = DIGITS.format(text=text)
            raw = f"list_filter({raw}, lambda h: ({APART.format(text=text)}) AND length({d}) BETWEEN 13 AND 19 AND {LUHN.format(d=d)})"
        parts.append(raw)
    return "list_concat(" + ", ".join(parts) + ", [])"


HIT = "STRUCT(s INTEGER, e INTEGER, t VARCHAR, p DOUBLE)"


def by_score(name: str, source: str) -> str:
    """CTEs: from source (k, hits list) to `name` (k, s, e, t, p): same-type merging as gaps and islands, then the greedy choice."""
    return f"""
{name}_x AS (SELECT k, h.s AS s, h.e AS e, h.t AS t, h.p AS p FROM (SELECT k, unnest(hits) AS h FROM {source})),
{name}_y AS (SELECT *, max(e) OVER (PARTITION BY k, t ORDER BY s, e, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name}_x),
{name}_z AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY k, t ORDER BY s, e, p ROWS UNBOUNDED PRECEDING) AS island FROM {name}_y),
{name}_m AS (SELECT k, t, min(s) AS s, max(e) AS e, max(p) AS p FROM {name}_z GROUP BY k, t, island),
{name}_l AS (SELECT k, list({{'s': s, 'e': e, 't': t, 'p': p}} ORDER BY p DESC, s - e, s, t) AS l FROM {name}_m GROUP BY k),
{name} AS (SELECT k, h.s AS s, h.e AS e, h.t AS t, h.p AS p FROM (SELECT k, unnest(list_reduce(list_transform(l, lambda x: [x]),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.s < x[1].e AND x[1].s < a.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS h FROM {name}_l))"""


def by_start(name: str, source: str) -> str:
    return f"""
{name}_x AS (SELECT k, h.s AS s, h.e AS e, h.t AS t, h.p AS p FROM (SELECT k, unnest(hits) AS h FROM {source})),
{name}_l AS (SELECT k, list({{'s': s, 'e': e, 't': t, 'p': p}} ORDER BY s, s - e, t) AS l FROM {name}_x GROUP BY k),
{name} AS (SELECT k, h.s AS s, h.e AS e, h.t AS t, h.p AS p FROM (SELECT k, unnest(list_reduce(list_transform(l, lambda x: [x]),
  lambda acc, x: CASE WHEN x[1].s >= acc[len(acc)].e THEN list_concat(acc, x) ELSE acc END)) AS h FROM {name}_l))"""


def numbered(name: str, found: str, texts: str, request: str = "k", order: str = "0") -> str:
    """CTEs: hits (k, s, e, t) in texts (k, text, request, ord) to `name` (k, s, e, t, value, placeholder)."""
    return f"""
{name}_v AS (SELECT f.k, f.s, f.e, f.t, x.{request} AS r, {order} AS o, substr(x.text, f.s + 1, f.e - f.s) AS value FROM {found} f JOIN {texts} x ON f.k = x.k),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY r, value ORDER BY o, s) AS nth FROM {name}_v),
{name}_n AS (SELECT r, value, t, row_number() OVER (PARTITION BY r, t ORDER BY o, s) AS n FROM {name}_f WHERE nth = 1),
{name} AS (SELECT v.k, v.s, v.e, v.t, v.r, v.o, v.value, n.t AS pt, n.n, '[[' || n.t || '_' || n.n || ']]' AS placeholder FROM {name}_v v JOIN {name}_n n ON v.r = n.r AND v.value = n.value)"""


def spliced(name: str, labelled: str, texts: str) -> str:
    """CTEs: `name` (k, masked, n): texts with placeholders in place of hits, and how many there are."""
    return f"""
{name}_g AS (SELECT l.k, l.s, l.e, substr(x.text, coalesce(lag(l.e) OVER (PARTITION BY l.k ORDER BY l.s), 0) + 1, l.s - coalesce(lag(l.e) OVER (PARTITION BY l.k ORDER BY l.s), 0)) || l.placeholder AS piece FROM {labelled} l JOIN {texts} x ON l.k = x.k),
{name}_j AS (SELECT k, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last, count(*) AS n FROM {name}_g GROUP BY k),
{name} AS (SELECT x.k, coalesce(j.head, '') || substr(x.text, coalesce(j.last, 0) + 1) AS masked, CAST(coalesce(j.n, 0) AS INTEGER) AS n FROM {texts} x LEFT JOIN {name}_j j ON x.k = j.k)"""


def raw_language(text: str) -> str:
    """The detector's answer as SQL, from a text expression (not null): function words, else n-grams met with the profiles by a join."""
    n = lambda p: f"len(regexp_extract_all(tx, '{p}'))"
    scores = {code: f"len(list_filter(kn, lambda x: x IN ({', '.join(map(quoted, own))})))" for code, own in language.WORDS.items()}
    scores["zh"] = f"CASE WHEN {n(language.KANA)} = 0 THEN ({n(language.HAN)} + 1) // 2 ELSE 0 END"
    scores["ja"] = f"CASE WHEN {n(language.KANA)} > 0 THEN ({n(language.KANA)} + {n(language.HAN)} + 1) // 2 ELSE 0 END"
    scores["ko"] = f"({n(language.HANGUL)} + 1) // 2"
    rows = ", ".join(f"{{'s': -({e}), 'l': '{code}'}}" for code, e in sorted(scores.items()))
    known = ", ".join(sorted({quoted(w) for own in language.WORDS.values() for w in own}))
    profile = ", ".join(f"({quoted(g)}, '{code}', {w})" for g, own in language.PROFILES.weights.items() for code, w in sorted(own.items()))
    grams = """flatten(list_transform(ws, lambda w: flatten([list_filter(string_split(w, ''), lambda c: ord(c) > 127),
      list_transform(range(1, len(w) + 2), lambda i: substr('_' || w || '_', i, 2)), list_transform(range(1, len(w) + 1), lambda i: substr('_' || w || '_', i, 3))])))"""
    clear = f"(o[1].s < 0 AND o[1].l IN ('zh', 'ja', 'ko') OR o[1].s <= -{language.ENOUGH} AND o[1].s <= 2 * o[2].s)"
    words = f"SELECT tx, list_filter(string_split_regex(lower(tx), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM (SELECT {text} AS tx)"
    ranked = f"SELECT ws, list_sort([{rows}]) AS o FROM (SELECT tx, ws, list_filter(ws, lambda x: x IN ({known})) AS kn FROM ({words}))"
    # only what words leave open is taken apart
    asked = f"SELECT CASE WHEN {clear} THEN o[1].l END AS sure, CASE WHEN NOT {clear} AND coalesce(list_sum(list_transform(ws, lambda w: len(w))), 0) >= {language.LETTERS} THEN {grams} END AS gs FROM ({ranked})"
    by_grams = f"(SELECT p.l FROM (SELECT unnest(gs) AS g) JOIN (VALUES {profile}) AS p(g, l, w) USING (g) GROUP BY p.l ORDER BY sum(w) DESC, p.l LIMIT 1)"
    return f"(SELECT CASE WHEN l = 'no' THEN 'nb' ELSE l END FROM (SELECT coalesce(sure, {by_grams}) AS l FROM ({asked})))"
