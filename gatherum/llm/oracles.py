"""SQL equivalents of the training-data queries that SQL can express, built from the same fixed values."""

from __future__ import annotations

from gatherum.llm import licenses, url_filter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_case(column: str) -> str:
    cases = []
    for action, rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        fits = f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash}{rest}')"
        cases.append(f"WHEN {fits} THEN '{rule if column == 'rule' else action}'")
    return f"CASE {' '.join(cases)} END"


def _strength(table: str) -> str:
    m = "greatest(least(m, 1 - 1e-6), 1e-6)"
    z = f"pow(k - n * {m}, 2) / (n * {m} * (1 - {m}))"
    rho = f"coalesce(sum(CASE WHEN n > 1 THEN {z} - 1 END) / sum(CASE WHEN n > 1 THEN n - 1 END), 0)"
    return (
        f"SELECT greatest({url_filter.WEAKEST}, least({url_filter.STRONGEST}, 1 / greatest({rho}, 1e-6) - 1)) AS s FROM {table}"
    )


def _level(name: str, source: str) -> str:
    return (
        f"{name}_in AS ({source}), {name}_s AS ({_strength(f'{name}_in')}), "
        f"{name} AS (SELECT *, k + m * s AS a, n - k + (1 - m) * s AS b FROM {name}_in, {name}_s)"
    )


def url_filter_sql(max_bad: float = 0.5, z: float = 1.645) -> str:
    two = ", ".join(_quoted(t) for t in url_filter.TWO_LABELS)
    last = lambda n: f"array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
    lower = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
    return f"""
WITH own AS (
  SELECT page_id, {lower} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
marks AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS k
  FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k,
         CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain,
         CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix
  FROM own LEFT JOIN marks USING (page_id) GROUP BY host),
{_level("suffixes", "SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM hosts) AS m FROM hosts GROUP BY suffix")},
{_level("domains", "SELECT h.*, a / (a + b) AS m FROM (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain) h JOIN (SELECT suffix, a, b FROM suffixes) u USING (suffix)")},
{_level("judged", "SELECT h.*, a / (a + b) AS m FROM hosts h JOIN (SELECT domain, a, b FROM domains) u USING (domain)")},
bounds AS (
  SELECT host, n, k, greatest(0, a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) AS bound
  FROM judged)
SELECT page_id, host, path, {_rule_case("rule")} AS rule,
       coalesce({_rule_case("action")}, CASE WHEN bound > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(k AS BIGINT) AS n_bad, round(bound, 6) AS bad_bound
FROM own JOIN bounds USING (host)"""


def licenses_sql() -> str:
    ends = licenses.ENDS.replace("\\x0B", "\\v")
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in licenses.KNOWN.items()) + "}"

    lower = "lower(coalesce(text, ''))"
    address = licenses.ADDRESS.replace("\\x0B", "\\v")

    def ids(text: str) -> str:
        plain = f"regexp_replace(regexp_replace({text}, '{ends}', chr(10), 'g'), '{licenses.OTHER}', ' ', 'g')"
        bare = f"regexp_replace(regexp_replace({plain}, ' ?\\n ?', chr(10), 'g'), '^ | $', '', 'g')"
        parts = f"list_filter(string_split({bare}, chr(10)), lambda s: map_contains(known, s))"
        return f"CASE WHEN regexp_matches({lower}, '{licenses.HINTS}') THEN list_transform({parts}, lambda s: known[s]) ELSE [] END"

    by_space = f"replace({lower}, chr(10), ' ')"
    by_address = f"regexp_replace({by_space}, '{address}', chr(10), 'g')"
    rests = ", ".join(f"',' || array_to_string({c}, ',') || ',' AS {r}" for c, r in (("by_line", "a"), ("by_space", "b"), ("by_address", "c")))
    steps = [f"s0 AS (SELECT *, {rests}, false AS fa, false AS fb, false AS fc FROM read)"]
    found: dict[str, list[str]] = {}
    for i, (name, parts) in enumerate(licenses.RULES):
        pattern = _quoted(licenses.sequence_of(parts))
        found.setdefault(name, []).append(f"h{i}")
        rest = (lambda c, p=pattern: f"replace({c}, {p}, ',') AS {c}") if len(parts) > 1 else (lambda c: c)
        fits = ", ".join(f"f{c} OR contains({c}, {pattern}) AS f{c}" for c in "abc")
        hit = " OR ".join(f"contains({c}, {pattern})" for c in "abc")
        steps.append(
            f"s{i + 1} AS (SELECT * EXCLUDE (a, b, c, fa, fb, fc), {', '.join(map(rest, 'abc'))}, {fits}, {hit} AS h{i} FROM s{i})"
        )
    names = ", ".join(f"CASE WHEN {' OR '.join(hits)} THEN {_quoted(name)} END" for name, hits in found.items())
    return f"""
WITH known AS (SELECT {known} AS known),
read AS (
  SELECT doc_id, {ids(lower)} AS by_line, {ids(by_space)} AS by_space,
         CASE WHEN regexp_matches({lower}, '{address}') THEN {ids(by_address)} ELSE [] END AS by_address
  FROM documents, known),
{", ".join(steps)}
SELECT doc_id, CAST(len(used) AS BIGINT) AS n_sentences, array_to_string(used, ',') AS sentence_ids,
       array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS licenses
FROM (SELECT *, CASE WHEN fa THEN by_line WHEN fb THEN by_space WHEN fc THEN by_address ELSE by_line END AS used
      FROM s{len(licenses.RULES)})"""


ORACLES = {"op2_url_filter": url_filter_sql(), "op9_licenses": licenses_sql()}
