"""URL filter by a path-template tree per host, in SQL only.

1. Each URL is split into host and path; listed rules (host suffix and path prefix, longest first) decide what they fit.
2. Path segments become template segments: runs of digits are generalised at once; a node with more than MANY different
   children of fewer than FEW pages each gets one wildcard child instead. The tree is as deep as the deepest path of the
   table; of paths with more than MOST segments (no real ones) the rest is one segment of the last level.
3. What rules decided are the labels. From the host down, siblings are ordered by their smoothed share of blocked pages
   and merged while neighbours don't differ by more than Z standard errors; the purity of a merged branch is its blocked
   share, smoothed towards its parent's by WEIGHT pages (the root: towards the share over all hosts). Below its last
   segment a path goes on with its purity, so how deep others are doesn't matter to a path.
4. A template is rejected if its purity is PURE or more; hosts without a labelled page are allowed.

Each step is one SELECT that Spark and other SQL engines read alike. Only counts per distinct template are grouped and
joined; pages are scanned for their url and joined once with the templates' verdicts (Spark broadcasts these while they
are small and splits skewed partitions otherwise).

The windows are per node of a host, and their rows are that node's different children, not its pages.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; repeated pages are judged each; an
empty table stays empty; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixeltide.llm.common import checkpoint

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MOST, MANY, FEW = 32, 30, 5
WEIGHT, Z, PURE = 4, 2, 0.5
MAX_RULES = 1000
EVERY = 4  # levels between two checkpoints

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rule_case(rules) -> str:
    """The longest rule that fits, as a CASE; ties go to the one that sorts first."""
    if not rules:
        return "CAST(NULL AS string)"
    out = []
    for rule in sorted((r for r, _ in rules), key=lambda r: (-len(r), r)):
        host, slash, path = rule.partition("/")
        fits = f"(host = {_quoted(host)} OR right(host, {len(host) + 1}) = {_quoted('.' + host)})"
        out.append(f"WHEN {fits} AND substr(path, 1, {len(slash + path)}) = {_quoted(slash + path)} THEN {_quoted(rule)}")
    return "CASE " + " ".join(out) + " END"


def steps(rules=RULES, depth: int = MOST, every: str = "") -> list[tuple[str, str]]:
    """(name, SELECT) in order; {name} stands for an earlier step or the pages. every: what an engine wants besides to replace all matches."""
    assert len(rules) <= MAX_RULES
    t = [f"t{i}" for i in range(1, depth + 1)]
    verdicts = " ".join(f"WHEN {_quoted(r)} THEN {_quoted(v)}" for r, v in rules)
    verdict = f"CASE rule {verdicts} END" if rules else "CAST(NULL AS string)"

    def seg(i):
        s = f"split_part(path, '/', {i + 1})" if i < depth else f"regexp_extract(path, '^{'[^/]*/' * depth}((?s:.*))', 1)"
        return f"regexp_replace({s}, '[0-9]+', '#'{every})"

    judged = f"""SELECT page_id, host, path, rule, {verdict} AS judged, {", ".join(f"{seg(i)} AS s{i}" for i in range(1, depth + 1))}
FROM (SELECT page_id, host, path, {_rule_case(rules)} AS rule
FROM (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {{pages}}) a) b) c"""
    raw = " || '/' || ".join(f"s{i}" for i in range(1, depth + 1))
    out = [
        ("judged", judged),
        (
            "leaf0",
            f"""SELECT host, raw, {", ".join(f"max(s{i}) AS t{i}" for i in range(1, depth + 1))}, count(*) AS n, count(rule) AS lab, count(CASE WHEN judged = 'block' THEN 1 END) AS bad
FROM (SELECT *, {raw} AS raw FROM {{judged}}) x GROUP BY host, raw""",
        ),
    ]
    for d in range(1, depth + 1):
        key = ", ".join(["host", *t[: d - 1]])
        out.append((f"wild{d}", f"SELECT {key}, count(DISTINCT t{d}) > {MANY} AND sum(n) < {FEW} * count(DISTINCT t{d}) AS wild FROM {{leaf{d - 1}}} GROUP BY {key}"))
        same = " AND ".join(f"l.{k} = w.{k}" for k in ["host", *t[: d - 1]])
        columns = ", ".join(f"CASE WHEN w.wild THEN '*' ELSE l.t{i} END AS t{i}" if i == d else f"l.t{i}" for i in range(1, depth + 1))
        out.append((f"leaf{d}", f"SELECT l.host, l.raw, {columns}, l.n, l.lab, l.bad FROM {{leaf{d - 1}}} l JOIN {{wild{d}}} w ON {same}"))
    leaf = f"{{leaf{depth}}}"
    out.append(("root", f"SELECT (sum(bad) + 1e0) / (sum(lab) + 2e0) AS purity FROM {leaf}"))
    out.append(("node0", f"SELECT host, sum(lab) AS host_lab, (sum(bad) + {WEIGHT}e0 * max(r.purity)) / (sum(lab) + {WEIGHT}e0) AS purity FROM {leaf} CROSS JOIN {{root}} r GROUP BY host"))
    for d in range(1, depth + 1):
        up = ", ".join(["host", *t[: d - 1]])
        key = f"{up}, t{d}"
        same = " AND ".join(f"k.{c} = p.{c}" for c in ["host", *t[: d - 1]])
        columns = ", ".join(f"k.{c}" for c in ["host", *t[:d]])
        ended = f"(k.t{d} = '' AND k.t{d - 1} = '')" if d > 1 else "FALSE"  # the path was over before
        rated = f"""SELECT {columns}, k.lab, k.bad, p.host_lab, p.purity AS above, {ended} AS ended, CASE WHEN {ended} THEN 2 WHEN k.lab > 0 THEN 1 ELSE 0 END AS known, (k.bad + {WEIGHT}e0 * p.purity) / (k.lab + {WEIGHT}e0) AS rate
FROM (SELECT {key}, sum(lab) AS lab, sum(bad) AS bad FROM {leaf} GROUP BY {key}) k JOIN {{node{d - 1}}} p ON {same}"""
        marked = f"""SELECT *, CASE WHEN rate - lag(rate) OVER (PARTITION BY {up}, known ORDER BY rate, t{d}) > {Z}e0 * sqrt(spread + lag(spread) OVER (PARTITION BY {up}, known ORDER BY rate, t{d})) THEN 1 ELSE 0 END AS gap
FROM (SELECT *, rate * (1e0 - rate) / (lab + {WEIGHT}e0) AS spread FROM ({rated}) a) b"""
        grouped = f"SELECT *, sum(gap) OVER (PARTITION BY {up}, known ORDER BY rate, t{d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS branch FROM ({marked}) c"
        out.append((f"node{d}", f"""SELECT {key}, host_lab, CASE WHEN ended THEN above ELSE (sum(bad) OVER (PARTITION BY {up}, known, branch) + {WEIGHT}e0 * above) / (sum(lab) OVER (PARTITION BY {up}, known, branch) + {WEIGHT}e0) END AS purity FROM ({grouped}) d"""))
    same = " AND ".join(f"l.{c} = k.{c}" for c in ["host", *t])
    out.append(("template", f"SELECT l.host, l.raw, k.purity, CASE WHEN k.host_lab > 0 AND k.purity >= {PURE:e} THEN 'block' ELSE 'allow' END AS verdict FROM {leaf} l JOIN {{node{depth}}} k ON {same}"))
    own = " || '/' || ".join(f"p.s{i}" for i in range(1, depth + 1))
    out.append(("result", f"SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.judged, v.verdict) AS verdict FROM {{judged}} p LEFT JOIN {{template}} v ON p.host = v.host AND {own} = v.raw"))
    return out


def depth_of(pages: DataFrame) -> int:
    """How many segments the deepest path has."""
    select = "SELECT max(length(path) - length(replace(path, '/', ''))) AS n FROM (SELECT regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM {pages} WHERE instr(url, '://') > 0) a"
    return max(1, min(MOST, pages.sparkSession.sql(select, pages=pages).first().n or 0))


def judge(pages: DataFrame, rules=RULES, depth: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url). depth: of the tree, where it is known."""
    spark = pages.sparkSession
    made = {"pages": pages.select("page_id", "url")}
    depth = depth or depth_of(made["pages"])
    last = (f"leaf{depth}", "leaf0", "template")
    for name, select in steps(rules, depth):
        df = spark.sql(select, **{k: v for k, v in made.items() if "{" + k + "}" in select})
        level = int(name[4:]) if name[:4] in ("leaf", "node") else 0
        made[name] = checkpoint(df) if name in last or level and level % EVERY == 0 else df
    return made["result"]


def sql(pages: str = "pages", rules=RULES, depth: int = 8) -> str:
    """The same as one statement, for engines that replace all matches of a pattern by the option g; for paths of at most `depth` segments."""
    all_steps = steps(rules, depth, ", 'g'")
    names = {name: name for name, _ in all_steps} | {"pages": pages}
    *before, (_, last) = [(name, select.format(**names)) for name, select in all_steps]
    return "WITH " + ",\n".join(f"{name} AS ({select})" for name, select in before) + "\n" + last
