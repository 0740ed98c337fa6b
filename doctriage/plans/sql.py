"""SQL texts for checking the queries on another engine, and the pieces they share."""

from __future__ import annotations

from doctriage.functions import fixed


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


# Patterns of the check itself, written apart from those of the code. This engine's matcher
# needs no guard against deep or slow matches.
MARKUP = ["<!--(.|\\n)*?-->", "</?[A-Za-z](\"[^\"]*\"|'[^']*'|[^'\">])*>", "</?[A-Za-z][^>]*>",
          "<[?!][^>]*>"]
SCRIPTS = [f"(?i)<{name}\\b[^>]*>(.|\\n)*?</{name}[[:space:]]*>" for name in ("script", "style")]


def html_sql(column: str, keep_scripts: bool = False) -> str:
    """Markup removal and the references that plain pages use."""
    out = column
    for pattern in MARKUP[:1] + ([] if keep_scripts else SCRIPTS) + MARKUP[1:]:
        out = f"regexp_replace({out}, {quoted(pattern)}, '', 'g')"
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "),
                       ("apos", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        out = f"replace({out}, '&{name};', {quoted(char)})"
    return out


def clean_sql(column: str) -> str:
    spaced = f"regexp_replace(lower({html_sql(column)}), '[/(){{}}\\[\\]|@,;]', ' ', 'g')"
    kept = f"regexp_replace({spaced}, '[^0-9a-z #+_]', '', 'g')"
    return (f"array_to_string(list_filter(string_split({kept}, ' '), lambda w: w <> '' "
            f"AND w NOT IN ({sql_list(fixed.STOP_WORDS)})), ' ')")


def words_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def filterset_sql(column: str) -> str:
    spaces = " " * len(fixed.TOKENIZER_FILTER)
    return (f"list_filter(string_split(translate(lower({column}), "
            f"{quoted(fixed.TOKENIZER_FILTER)}, '{spaces}'), ' '), lambda w: w <> '')")


IS_TEST = "substr(md5('42:' || doc_id), 1, 8) < '4ccccccc'"

CLEAN = f"""clean AS (
  SELECT doc_id, lang, {clean_sql('text')} AS text, {IS_TEST} AS is_test FROM documents)"""

WEIGHTS = f"""{CLEAN},
tokens AS (SELECT doc_id, lang, is_test, unnest({words_sql('text')}) AS term FROM clean),
counts AS (SELECT doc_id, lang, is_test, term, count(*) AS tf FROM tokens GROUP BY ALL),
size AS (SELECT count(*) AS n FROM clean WHERE NOT is_test),
idf AS (SELECT term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf
        FROM counts, size WHERE NOT is_test GROUP BY term, n),
raw AS (SELECT c.*, tf * idf AS raw FROM counts c JOIN idf USING (term)),
weights AS (SELECT doc_id, lang, is_test, term, tf,
              raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def bayes_sql(scored: str = "SELECT doc_id AS id, lang AS label, text FROM clean WHERE is_test",
              prior: str = "ln(count(*)::DOUBLE / n)") -> str:
    """CTEs down to ``probabilities(id, label, class, score, probability)`` and
    ``predictions(id, label, prediction, score)``."""
    return f"""{WEIGHTS},
classes AS (SELECT lang AS class, {prior} AS prior
            FROM clean, size WHERE NOT is_test GROUP BY lang, n),
sums AS (SELECT lang AS class, term, sum(weight) AS s FROM weights WHERE NOT is_test GROUP BY ALL),
totals AS (SELECT class, sum(s) AS t FROM sums GROUP BY class),
vocabulary AS (SELECT count(*) AS v FROM idf),
scored AS ({scored}),
scored_raw AS (
  SELECT id, term, count(*) * idf AS raw
  FROM (SELECT id, unnest({words_sql('text')}) AS term FROM scored) JOIN idf USING (term)
  GROUP BY id, term, idf),
scored_weights AS (
  SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM scored_raw),
dots AS (
  SELECT w.id, t.class, sum(w.weight * ln((coalesce(s.s, 0) + 1) / (t.t + v))) AS dot
  FROM scored_weights w CROSS JOIN totals t CROSS JOIN vocabulary
  LEFT JOIN sums s ON s.term = w.term AND s.class = t.class GROUP BY ALL),
scores AS (
  SELECT d.id, d.label, c.class, c.prior + coalesce(dots.dot, 0) AS score
  FROM scored d CROSS JOIN classes c
  LEFT JOIN dots ON dots.id = d.id AND dots.class = c.class),
probabilities AS (
  SELECT *, exp(score - max(score) OVER (PARTITION BY id))
    / sum(exp(score)) OVER (PARTITION BY id) * exp(max(score) OVER (PARTITION BY id))
    AS probability FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS place
           FROM scores),
predictions AS (SELECT id, label, class AS prediction, score FROM ranked WHERE place = 1)"""


def report_sql(pairs: str) -> str:
    """Report rows from CTEs ending in ``pairs(label, prediction)``."""
    return f"""WITH {pairs},
names AS (SELECT label AS class FROM pairs UNION SELECT prediction FROM pairs),
per_class AS (
  SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp,
    count(*) FILTER (label = class) AS support,
    count(*) FILTER (prediction = class) AS predicted
  FROM names CROSS JOIN pairs GROUP BY class),
rates AS (
  SELECT class, tp, support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS p,
    CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS r FROM per_class),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM rates),
report AS (
  SELECT class, p, r, f, support FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support)::DOUBLE, sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  support::BIGINT AS support FROM report"""


# ---- stamped rows: a phrase, a model label and a probability per document ------------

STAMPS = ["", "Refill order", "account statement enclosed", "Broadband dues", "Tata Docomo",
          "bank pass book", "cheque enclosed", "42 kWh units", "my bank dues", "uidai number",
          "Unique Identification Authority of India", "Permanent Account Number",
          "telephone line"]
LABELS = fixed.TAGS + ["voterID"]
LADDER = [1.0, 0.99999, 0.8, 0.5, 0.46, 0.3, 1e-4, 9.9e-5, 1.5e-7, 2e-5, 0.0]
OTHER_CLASSES = len(fixed.TAGS) - 1
SUFFIXES = fixed.IMAGE_SUFFIXES + fixed.PDF_SUFFIXES + ["Png", "txt", "tar.jpg", ""]


def pick_sql(values: list, kind: str = "VARCHAR") -> str:
    items = ", ".join(repr(v) if isinstance(v, float) else quoted(v) for v in values)
    return f"([{items}]::{kind}[])[1 + doc_id % {len(values)}]"


RAW_STAMPED = f"text || ' ' || {pick_sql(STAMPS)}"
STAMPED = f"""stamped AS (
  SELECT doc_id, lower({RAW_STAMPED}) AS raw_text, {clean_sql('(' + RAW_STAMPED + ')')} AS text,
    {pick_sql(LABELS)} AS label, {pick_sql(LADDER, 'DOUBLE')} AS p1 FROM documents),
gates AS (
  SELECT *, split_part(p1::VARCHAR, '.', 1) AS printed,
    greatest(p1, (1 - p1) / {OTHER_CLASSES}) AS top FROM stamped),
decided AS (
  SELECT *, CASE WHEN NOT regexp_full_match(printed, '[0-9]+') THEN 'error'
      WHEN printed::INT > 0 THEN 'accept' ELSE 'reject' END AS gate,
    CASE WHEN top > 0.7 THEN 'accept' ELSE 'reject' END AS gate_general,
    CASE WHEN top > 0.45 THEN 'accept' ELSE 'reject' END AS gate_utility,
    string_split(text, ' ') AS tokens, string_split(raw_text, ' ') AS raw_tokens,
    regexp_matches(text, 'gas|oil|refill') AS gas,
    regexp_matches(raw_text, 'gas|oil|refill') AS raw_gas FROM gates)"""

NONE = quoted(fixed.UNCLASSIFIED)
GENERAL_NAMES = """CASE c WHEN 'aadhar' THEN 'Aadhar Card' WHEN 'drivingLicense' THEN
  'Driving License' WHEN 'voterID' THEN 'Voter ID' ELSE c END"""
IDENTITY_NAMES = "CASE c WHEN 'aadhar' THEN 'aadhar card' WHEN 'pan' THEN 'pan card' ELSE c END"
DENIED = sql_list(fixed.IDENTITY_DENIED)
PHONE_FIXED = "|".join(w.lower().replace("+", "[+]") for w in fixed.PHONE_WORDS_SHORT)


def flow_sql(compat: str | None, fixed_case: str, names: str = "c",
             compat_names: str | None = None, compat_errors: bool = True) -> str:
    """One row per document with class and outcome in both modes."""
    compat_names = names if compat_names is None else compat_names
    error = "gate = 'error'" if compat_errors else "false"
    outcome = ("CASE WHEN {c} IS NULL THEN 'error' WHEN {c} = " + NONE
               + " THEN 'unclassified' ELSE 'ok' END AS {c}_outcome")
    columns, parts = [], []
    if compat:
        columns.append(f"(SELECT {compat_names} FROM (SELECT CASE WHEN {error} THEN NULL "
                       f"{compat} END AS c)) AS compat")
        parts += ["compat AS compat_class", outcome.format(c="compat")]
    columns.append(f"(SELECT {names} FROM (SELECT CASE {fixed_case} END AS c)) AS fixed")
    parts += ["fixed AS fixed_class", outcome.format(c="fixed")]
    return (f"WITH {STAMPED}, final AS (SELECT doc_id, {', '.join(columns)} FROM decided) "
            f"SELECT doc_id, {', '.join(parts)} FROM final")


FLOW_SQL = {
    "general": flow_sql(
        f"WHEN gate = 'accept' THEN label WHEN gas THEN 'Gas Bills' ELSE {NONE}",
        f"WHEN gate_general = 'accept' THEN label WHEN gas THEN 'Gas Bills' ELSE {NONE}",
        GENERAL_NAMES),
    "utility": flow_sql(
        f"""WHEN gas THEN 'gasbill' WHEN gate = 'accept' THEN label
        WHEN regexp_matches(text, 'account statement|statement account|transaction|statement period')
          THEN 'bankstatement'
        WHEN regexp_matches(text, 'broadband|telephone') THEN 'phonebill'
        WHEN regexp_matches(text, 'kw|kvah|tangedco') THEN 'electricitybill' ELSE {NONE}""",
        f"""WHEN gas THEN 'gasbill' WHEN gate_utility = 'accept' THEN label
        WHEN regexp_matches(text, 'account statement|statement account|transaction|statement period')
          THEN 'bankstatement'
        WHEN regexp_matches(text, '{PHONE_FIXED}|telephone') THEN 'phonebill'
        WHEN (label = 'bankPassbook' AND list_contains(tokens, 'bank'))
          OR contains(text, 'pass book') OR list_contains(tokens, 'cheque') THEN 'bankPassbook'
        WHEN regexp_matches(text, 'kw|kvah|tangedco') THEN 'electricitybill'
        WHEN label = 'bankStatement' AND list_contains(tokens, 'bank') THEN 'bankstatement'
        ELSE {NONE}"""),
    "identity": flow_sql(
        f"""WHEN gate = 'accept' AND label IN ({DENIED}) THEN {NONE} WHEN gate = 'accept' THEN label
        WHEN gas THEN {NONE} WHEN contains(text, 'uidai') THEN 'aadhar' ELSE {NONE}""",
        f"""WHEN gate_general = 'accept' AND label IN ({DENIED}) THEN {NONE}
        WHEN gate_general = 'accept' THEN label WHEN gas THEN {NONE}
        WHEN regexp_matches(text, 'uidai|unique identification authority india') THEN 'aadhar'
        WHEN contains(text, 'permanent account number') THEN 'pan' ELSE {NONE}""",
        IDENTITY_NAMES),
    "embedding_general": flow_sql(
        "ELSE label",
        f"WHEN gate_general = 'accept' THEN label WHEN raw_gas THEN 'Gas Bills' ELSE {NONE}",
        GENERAL_NAMES, compat_names="c", compat_errors=False),
    "embedding_utility": flow_sql(
        None,
        f"""WHEN raw_gas THEN 'gasbill' WHEN gate_utility = 'accept' THEN label
        WHEN regexp_matches(raw_text, '{PHONE_FIXED}') THEN 'phonebill'
        WHEN (label = 'bankPassbook' AND list_contains(raw_tokens, 'bank'))
          OR contains(raw_text, 'pass book') OR list_contains(raw_tokens, 'cheque')
          THEN 'bankPassbook'
        WHEN regexp_matches(raw_text, 'kw|kvah|tangedco') THEN 'electricitybill'
        WHEN label = 'bankStatement' AND list_contains(raw_tokens, 'bank') THEN 'bankstatement'
        WHEN regexp_matches(raw_text, 'account statement|statement account|transaction')
          THEN 'bankstatement' ELSE {NONE}"""),
}
