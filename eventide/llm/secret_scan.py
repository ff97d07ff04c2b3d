"""Secrets in whole texts: a trigram index picks candidates, the rules verify them.

Every rule's regular expression is turned into a Boolean query over trigrams that
any match must contain. The index holds, for the trigrams some query asks for, the
ids of the documents they occur in; postings are combined per rule, and only the
remaining documents are searched with that rule. A rule whose matches share no
trigram is searched everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More alternatives than this are not expanded into literal strings.
MAX_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The first three kinds are fixed values of the task, in their listed order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _split_top(pattern: str, at: str) -> list[str]:
    parts, depth, in_class, i, last = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif not in_class and c in "()":
            depth += 1 if c == "(" else -1
        elif not in_class and not depth and c == at:
            parts.append(pattern[last:i])
            last = i + 1
        i += 1
    return [*parts, pattern[last:]]


_ATOM = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|(\[\^?\]?(?:\\.|[^\]\\])*\])|(\()|(.)", re.S)
_TIMES = re.compile(r"\?|\*|\+|\{(\d+)(,?)(\d*)\}")


def _class_members(body: str) -> set[str] | None:
    """Members of a bracket class of few plain characters, else None."""
    inner = body[1:-1]
    if inner.startswith("^") or "-" in inner[1:-1] or "\\" in inner:
        return None
    return set(inner)


def trigram_queries(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigram sets, in lower case; every match contains one whole set.

    An empty list means that no trigram is mandatory. Parts of the expression are
    expanded to literal strings while there are few; anything else ends the
    current run of literals, whose trigrams then are one conjunct.
    """
    pattern = pattern.removeprefix("(?i)")
    found = [_strings_query(runs) for runs in _runs(pattern)]
    found = [q for q in found if q]
    # a conjunct with few, long alternatives is the most selective one
    return min(found, key=lambda q: (-min(map(len, q)), len(q)), default=[])


def _strings_query(strings: set[str]) -> list[frozenset[str]]:
    grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [] if frozenset() in grams else sorted(grams, key=sorted)


def _runs(pattern: str) -> list[set[str]]:
    """Sets of literal strings, each of which every match must hold one of."""
    out: list[set[str]] = []
    current: set[str] = {""}
    i = 0
    while i < len(pattern):
        atom = _ATOM.match(pattern, i)
        i = atom.end()
        choices: set[str] | None
        if atom[1]:
            choices = {chr(int(atom[1], 16))}
        elif atom[2]:
            choices = {atom[2]} if not atom[2].isalnum() else None
        elif atom[3]:
            choices = _class_members(atom[3])
        elif atom[4]:
            depth, start = 1, i
            while depth:
                step = 2 if pattern[i] == "\\" else 1
                depth += {"(": 1, ")": -1}.get(pattern[i], 0)
                i += step
            choices = set()
            for branch in _split_top(pattern[start:i - 1].removeprefix("?:"), "|"):
                inner = _exact(branch)
                choices = None if choices is None or inner is None else choices | inner
        else:
            choices = None if atom[5] in ".^$" else {atom[5]}
        times = _TIMES.match(pattern, i)
        closes = choices is None
        if times:
            i = times.end()
            if times[0] == "?":
                choices = None if choices is None else choices | {""}
            elif times[0] == "*":
                choices, closes = None, True
            else:  # at least once: the literal stands, what follows it is open
                closes = True
        lower = None if choices is None else {c.lower() for c in choices}
        if lower is not None and len(lower) * len(current) <= MAX_STRINGS:
            current = {a + b for a, b in product(current, lower)}
        else:
            out.append(current)
            current = {""} if lower is None or len(lower) > MAX_STRINGS else lower
        if closes:
            out.append(current)
            current = {""}
    return [*out, current]


def _exact(branch: str) -> set[str] | None:
    """All strings of a branch without repeats, or None."""
    runs = _runs(branch)
    return runs[0] if len(runs) == 1 else None


def trigram_index(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (gram, doc_id) of the asked trigrams over the texts in lower case."""
    low = F.lower(F.col(text_col))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i))
                                     for i, g in enumerate(grams)]))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(hits).alias("gram"))


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Per document the rules whose trigram query holds: postings are united bit by bit."""
    bit = {g: i for i, g in enumerate(grams)}
    words = len(grams) // 63 + 1
    sets = [F.expr(f"bit_or(if(gram div 63 = {w}, shiftleft(1L, cast(gram % 63 as int)), 0L))").alias(f"set{w}")
            for w in range(words)]
    united = index.groupBy("doc_id").agg(*sets)

    def holds(alternatives: list[frozenset[str]]) -> Column:
        any_of = F.lit(False)
        for grams_of in alternatives:
            all_of = F.lit(True)
            for w in range(words):
                mask = sum(1 << bit[g] % 63 for g in grams_of if bit[g] // 63 == w)
                all_of = all_of & (F.col(f"set{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
            any_of = any_of | all_of
        return any_of

    named = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return united.select("doc_id", named.alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's leftmost non-overlapping matches, in code points.

    Matches and the gaps between them alternate, so running sums of both lengths
    give the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<start:long,end:long>>")
    start_state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.when(x["match"].isNull(), state).otherwise(F.struct(
            end.alias("at"),
            F.when(F.length(x["value"]) >= rule.least, F.concat(state["spans"], one))
            .otherwise(state["spans"]).alias("spans")))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value"))
    walked = F.aggregate(zipped, start_state, step, lambda s: s["spans"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), walked).otherwise(none)


def _listed(rules: tuple[Rule, ...]) -> Column:
    """Spans of the rules as ``kind:start:end`` in order of start, then rule."""
    def ranked(rank: int, kind: str) -> Column:
        return F.transform(F.col(f"m_{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    spans = F.concat(*[ranked(i, r.kind) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, rules tried, and an array of spans ``m_<kind>`` per rule.

    A null or empty text has no spans. Rows with the same id share their candidate
    rules (a superset) and are verified apart, so repeated rows and null ids get
    their own right spans. Other columns are ignored; an empty table gives no rows.
    """
    clean = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = {r.kind: q for r in rules if (q := trigram_queries(r.pattern))}
    grams = sorted({g for q in asked.values() for s in q for g in s})
    picked = candidates(trigram_index(clean, grams, "doc_id", "text"), grams, asked).select(
        F.col("doc_id").alias("picked_id"), F.col("rules").alias("tried"))
    joined = clean.join(picked, F.col("doc_id").eqNullSafe(F.col("picked_id")), "left").select(
        "doc_id", "text", F.coalesce("tried", F.array().cast("array<string>")).alias("tried"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    columns = [(F.when(F.array_contains("tried", r.kind), matches(F.col("text"), r)).otherwise(none)
                if r.kind in asked else matches(F.col("text"), r)).alias(f"m_{r.kind}") for r in rules]
    return joined.select("doc_id", "tried", *columns)


def secret_report(scanned: DataFrame) -> DataFrame:
    """The contract's columns from a scan with the standard rules."""
    return scanned.select(
        "doc_id", *[F.size(f"m_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed(BASE).cast("binary"), 256).alias("base_sha256"),
        _listed(RULES).alias("spans"))
