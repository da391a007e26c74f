"""Problem 7: mapping freely typed values to the entries of a reference list.

Method: partition-based pigeonhole join, in SQL only. Every entry is spelled out in the forms in which
people write it (words rotated, abbreviated, in the plural, cut to the leading words, as an acronym), each
reduced to its letters and digits. A form of n characters that may differ by k edits is cut into k + 1
segments; an edit can spoil only one of them, so a value within k edits has at least one segment at
its place, shifted by k at most. The join is an equality on (field, length, segment number, substring); the candidates
are verified with ``levenshtein``. Of a value that matches no form, every run of neighbouring words is tried likewise, since words
may be added to a name anywhere. Values that no form matches are found by an anti-join and reported with -1.

Values are made distinct before the join, so a frequent value is matched once however many rows hold it.
The list of forms grows with the reference list only.

Defined results: null and blank elements, ``None``, and elements spelled exactly like an entry give no
row. Of several entries within reach the fewest edits win, then the one nearest in length, then the smaller term_id. A null or empty list
gives no row; repeated elements give a row for each place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferrosieve.tables import settle

# How words are shortened or spelled otherwise. The key is a word (or words) of an entry in
# lower case, the values are the forms that may stand for it.
SHORT_FORMS = {
    "analyser": ["analyzer"],
    "array": ["arr", "ar"],
    "camera": ["cam"],
    "centre": ["center"],
    "colour": ["color"],
    "dynamics": ["dyn"],
    "engine": ["eng"],
    "generator": ["gen"],
    "infrared": ["ir"],
    "library": ["lib"],
    "long-range": ["lr"],
    "measurement": ["meas"],
    "near-infrared": ["nir"],
    "network": ["net"],
    "optical": ["opt"],
    "polarisation": ["polarization", "pol"],
    "positioning": ["pos"],
    "pressure": ["press"],
    "receiver": ["recv"],
    "scenario": ["scen"],
    "sensor": ["sens"],
    "short-range": ["sr"],
    "simulator": ["sim"],
    "synthesiser": ["synthesizer"],
    "time-of-flight": ["tof"],
    "tyre": ["tire"],
    "ultrasonic": ["us"],
    "vehicle": ["veh"],
}
# Fixed value: words that an acronym leaves out.
ACRONYM_STOPS = ("of", "and", "the", "for")

_EDITS = "CASE WHEN length({0}) >= 7 THEN 2 WHEN length({0}) >= 5 THEN 1 ELSE 0 END"


def _forms_sql(cut_fields: tuple[str, ...]) -> str:
    """All written forms of the entries: field_name, term_id, form, k."""
    shorts = ", ".join(f"'{w}', array({', '.join(repr(x) for x in xs)})" for w, xs in SHORT_FORMS.items())
    cuts = ", ".join(f"'{f}'" for f in cut_fields) or "''"
    stops = ", ".join(f"'{w}'" for w in ACRONYM_STOPS)
    return f"""
WITH words AS (
  SELECT field_name, term_id, filter(split(lower(canonical_name), '[^0-9a-z-]+'), x -> x <> '') AS w
  FROM {{terms}} WHERE canonical_name IS NOT NULL),
choices AS (
  SELECT *, transform(w, x -> concat(array(x), coalesce(map({shorts})[x], array()))) AS c FROM words WHERE size(w) > 0),
spelled AS (
  SELECT field_name, term_id, w, explode(aggregate(c, array(cast(array() AS array<string>)),
    (acc, alt) -> flatten(transform(acc, a -> transform(alt, t -> array_append(a, t)))))) AS s FROM choices),
plural AS (
  SELECT field_name, term_id, explode(array(s, transform(s, (x, i) -> if(i = size(s) - 1, x || 's', x)))) AS s FROM spelled),
leading AS (
  SELECT field_name, term_id, slice(s, 1, r) AS s FROM (SELECT field_name, term_id, s, explode(sequence(1, size(s) - 1)) AS r FROM spelled WHERE size(s) > 1 AND field_name IN ({cuts}))),
parts AS (
  SELECT field_name, term_id, split(array_join(s, '-'), '-') AS s, 1 AS full FROM plural
  UNION ALL
  SELECT field_name, term_id, split(array_join(s, '-'), '-'), 0 FROM leading WHERE length(array_join(s, '')) >= 6),
turned AS (
  SELECT field_name, term_id, s, full, explode(sequence(0, size(s) - 1)) AS r FROM parts),
joined AS (
  SELECT field_name, term_id, array_join(concat(slice(s, r + 1, size(s) - r), slice(s, 1, r)), '') AS t, full FROM turned
  UNION ALL
  SELECT field_name, term_id, array_join(concat(slice(s, r + 1, size(s) - r), slice(s, 1, r)), '') || 's', full FROM turned WHERE r > 0 AND full = 1
  UNION ALL
  SELECT field_name, term_id, array_join(transform(filter(split(array_join(w, '-'), '-'), x -> x NOT IN ({stops})), x -> substring(x, 1, 1)), ''), 2 FROM words WHERE size(split(array_join(w, '-'), '-')) > 2),
compact AS (SELECT DISTINCT field_name, term_id, regexp_replace(t, '[^0-9a-z]', '') AS form, full FROM joined),
spans AS (SELECT field_name, term_id, length(array_join(w, '')) AS whole FROM words)
SELECT c.field_name, c.term_id, c.form, max(s.whole) AS whole, max(CASE WHEN full = 2 THEN 0 ELSE {_EDITS.format("c.form")} END) AS k
FROM compact c JOIN spans s ON s.field_name = c.field_name AND s.term_id = c.term_id WHERE form <> ''
GROUP BY c.field_name, c.term_id, c.form"""


# What people add to a name besides words: trade signs, remarks in brackets, a bracket that a cut or turn left open, counts and
# versions, articles. Words are handled by the windows below.
_ADDITIONS = [
    (r"[\\u00ae\\u2122\"\\u201c\\u201d\\u00ab\\u00bb]", " "),
    (r"\\([^()]*\\)|\\[[^\\[\\]]*\\]", " "),
    (r"^[^(\\[]*[)\\]]|[(\\[][^)\\]]*$", " "),
    (r"\\b[0-9]+\\s*x(?=[\\s_-])|\\bv?[0-9]+([.][0-9]+)*\\b|v[0-9]+([.][0-9]+)*\\b", " "),
    (r"^[\\s_]*(one|the|a)[\\s_]+|[\\s_/,-]+(one|the)[\\s_/,-]*$", " "),
]


def _cleaned_sql(column: str) -> str:
    """A value in lower case without the usual additions."""
    out = f"lower({column})"
    for pattern, by in _ADDITIONS:
        out = f"regexp_replace({out}, '{pattern}', '{by}')"
    return out


# The pigeonhole join of (field_name, v) with the forms: field_name, v, term_id, whole, n, d.
_NEAR = """
segs AS (
  SELECT field_name, term_id, form, whole, k, length(form) AS n, i,
         substring(form, div(length(form) * i, k + 1) + 1, div(length(form) * (i + 1), k + 1) - div(length(form) * i, k + 1)) AS seg
  FROM (SELECT *, explode(sequence(0, k)) AS i FROM {forms})),
lens AS (SELECT field_name, v, explode(sequence(greatest(1, length(v) - 2), length(v) + 2)) AS n FROM vals),
parts AS (SELECT field_name, v, n, k, explode(sequence(0, k)) AS i FROM (SELECT *, CASE WHEN n >= 7 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END AS k FROM lens)),
places AS (SELECT *, explode(sequence(-k, k)) AS shift FROM parts WHERE abs(length(v) - n) <= k),
keys AS (
  SELECT DISTINCT field_name, v, n, i, substring(v, div(n * i, k + 1) + 1 + shift, div(n * (i + 1), k + 1) - div(n * i, k + 1)) AS seg
  FROM places WHERE div(n * i, k + 1) + shift >= 0),
near AS (
  SELECT vals.field_name, v, term_id, whole, length(form) AS n, 0 AS d FROM vals JOIN {forms} f ON f.field_name = vals.field_name AND f.form = v
  UNION ALL
  SELECT s.field_name, keys.v, s.term_id, s.whole, s.n, levenshtein(keys.v, s.form, s.k) AS d
  FROM keys JOIN segs s ON s.field_name = keys.field_name AND s.n = keys.n AND s.i = keys.i AND s.seg = keys.seg)"""

_MATCH = (
    """
WITH vals AS (SELECT DISTINCT field_name, v FROM {plain} WHERE v <> ''),"""
    + _NEAR
    + """,
best AS (SELECT field_name, v, min(struct(d, abs(whole - length(v)) AS rest, term_id)).term_id AS term_id FROM near WHERE d >= 0 GROUP BY field_name, v)
SELECT p.field_name, p.value, b.term_id FROM {plain} p JOIN best b ON b.field_name = p.field_name AND b.v = p.v
"""
)

# Of a value that matches no form: its runs of neighbouring words, and what is left without an inner run of up to three words (a name turned
# around an addition). An article may be glued to a word. The longest match with the fewest edits wins; short forms are not misspelt here.
_WINDOWS = """
WITH words AS (
  SELECT field_name, value, filter(split(cleaned, '[^0-9a-z]+'), x -> x <> '') AS w FROM {plain} p
  WHERE NOT EXISTS (SELECT 1 FROM {matched} m WHERE m.field_name = p.field_name AND m.value = p.value)),
both AS (SELECT DISTINCT field_name, value, explode(array(w, transform(w, x -> regexp_replace(x, '^(one|the)(?=[a-z])', '')))) AS w FROM words),
starts AS (SELECT field_name, value, w, explode(sequence(1, size(w))) AS i FROM both WHERE size(w) > 0),
runs AS (SELECT field_name, value, w, i, explode(sequence(i, least(i + 7, size(w)))) AS j FROM starts)
SELECT DISTINCT field_name, value, v FROM (
  SELECT field_name, value, array_join(slice(w, i, j - i + 1), '') AS v FROM runs
  UNION ALL
  SELECT field_name, value, array_join(concat(slice(w, 1, i - 1), slice(w, j + 1, size(w))), '') AS v FROM runs WHERE i > 1 AND j < size(w) AND j - i < 3)"""

_INSIDE = (
    """
WITH vals AS (SELECT DISTINCT field_name, v FROM {windows} WHERE length(v) >= 5),"""
    + _NEAR
    + """
SELECT w.field_name, w.value, min(struct(n.d - n.n AS score, abs(n.whole - length(w.v)) AS rest, n.term_id)).term_id AS term_id
FROM {windows} w JOIN near n ON n.field_name = w.field_name AND n.v = w.v WHERE n.d = 0 OR n.d > 0 AND n.n >= 10
GROUP BY w.field_name, w.value
"""
)


def match(findings: DataFrame, terms: DataFrame, cut_fields: tuple[str, ...] = ("simulation_tools_or_solvers",)) -> DataFrame:
    """``finding_id``, ``field_name``, ``list_pos``, ``term_id`` of every typed element; -1 where no entry is meant.

    ``cut_fields`` are the fields whose entries may be cut to their leading words (product names).
    """
    sql = findings.sparkSession.sql
    elements = sql(
        r"""SELECT e.* FROM (
             SELECT finding_id, 'sensor_types' AS field_name, list_pos, value FROM {f} LATERAL VIEW posexplode(sensor_types) AS list_pos, value
             UNION ALL
             SELECT finding_id, 'simulation_tools_or_solvers', list_pos, value FROM {f} LATERAL VIEW posexplode(simulation_tools_or_solvers) AS list_pos, value) e
           LEFT ANTI JOIN {t} t ON t.field_name = e.field_name AND t.canonical_name = e.value
           WHERE value IS NOT NULL AND NOT value RLIKE '^[\\s\\p{{Z}}]*$' AND trim(value) <> 'None'""",
        f=findings.select("finding_id", "sensor_types", "simulation_tools_or_solvers"), t=terms.select("field_name", "canonical_name"),
    )
    elements = settle(elements, "p7-elements")
    forms = settle(sql(_forms_sql(cut_fields), terms=terms.select("field_name", "term_id", "canonical_name")), "p7-forms")
    plain = sql(
        f"""SELECT field_name, value, cleaned, regexp_replace(cleaned, '[^0-9a-z]', '') AS v
            FROM (SELECT field_name, value, {_cleaned_sql("value")} AS cleaned FROM (SELECT DISTINCT field_name, value FROM {{elements}}))""",
        elements=elements,
    )
    plain = settle(plain, "p7-values")
    direct = settle(sql(_MATCH, plain=plain, forms=forms), "p7-direct")
    windows = settle(sql(_WINDOWS, plain=plain, matched=direct), "p7-windows")
    added = sql(_INSIDE, windows=windows, forms=forms)
    return sql(
        """SELECT finding_id, e.field_name, CAST(list_pos AS int) AS list_pos, coalesce(m.term_id, -1L) AS term_id
           FROM {e} e LEFT JOIN {m} m ON m.field_name = e.field_name AND m.value = e.value""",
        e=elements, m=direct.unionByName(added),
    )
