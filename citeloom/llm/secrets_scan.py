"""Secret scans over a trigram index, in DataFrame operations only.

Every rule is a regular expression. From its syntax tree follows a Boolean query on trigrams
that any match must satisfy: a choice of branches, each a set of trigrams. Postings (trigram,
document) are kept for the trigrams that some rule asks for; a rule's candidates are the
documents that all postings of one of its branches share, and only these are searched. A rule
without mandatory trigrams searches every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the fewest characters that ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False


# Kinds, patterns and least lengths, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")

#: A class of more characters than this stands for any character.
WIDE = 8
#: Strings longer than this, or more of them, are cut: the query gets weaker, never wrong.
LONGEST, MOST = 24, 64


def java_pattern(rule: Rule) -> str:
    """The pattern for the JVM: a folding rule folds A-Z alone, and only in its first group."""
    return rule.pattern.replace("(", "((?i:", 1).replace(")", "))", 1) if rule.fold else rule.pattern


def _strings(tree) -> tuple[list[str], list[frozenset[str]]] | None:
    """What a syntax tree matches: its exact strings, if few, else None; see ``branches``."""
    found = [""]
    for op, value in tree:
        if op is K.LITERAL:
            more = [chr(value)]
        elif op is K.IN:
            more = _class(value)
        elif op is K.SUBPATTERN:
            more = _strings(value[3])
        elif op is K.BRANCH:
            parts = [_strings(x) for x in value[1]]
            more = None if None in parts else [s for p in parts for s in p]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[1] != K.MAXREPEAT and value[1] <= 2:
            one = _strings(value[2])
            more = None if one is None else ["".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)]
        else:
            more = None
        if more is None or len(found) * len(more) > MOST:
            return None
        found = [a + b for a in found for b in more]
    return found


def _class(items) -> list[str] | None:
    found: list[str] = []
    for op, value in items:
        if op is K.LITERAL:
            found.append(chr(value))
        elif op is K.RANGE and value[1] - value[0] < WIDE:
            found += map(chr, range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= WIDE else None


def branches(rule: Rule) -> list[frozenset[str]]:
    """The Boolean query of a rule: one set of trigrams of each branch must be in a text; no branch: search all texts.

    The tree's items are read from left to right; items with few strings are joined to longer
    strings, whose trigrams all must be there; any other item ends the string and asks nothing.
    """
    done: list[frozenset[str]] = [frozenset()]
    run = [""]

    def close() -> None:
        nonlocal done, run
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if all(sets) and len(done) * len(sets) <= MOST:  # else one string of the choice asks nothing, so the choice does
            done = list({a | b for a in done for b in sets})
        run = [""]

    for item in _parser.parse(rule.pattern):
        few = _strings([item])
        if few is None:
            close()
            op, value = item
            if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0 and (one := _strings(value[2])):
                run = one
                close()
        elif len(run) * len(few) > MOST or max(map(len, run)) > LONGEST:
            close()
            run = few
        else:
            run = [a + b for a in run for b in few]
    close()
    fold = str.lower if rule.fold else str
    return [] if frozenset() in done else sorted({frozenset(map(fold, x)) for x in done}, key=sorted)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``gram, fold, doc_id``: which documents have which of the trigrams that some rule asks for.

    With ``fold``, A-Z count as a-z.
    """
    asked = sorted({(g, r.fold) for r in rules for b in branches(r) for g in b})
    if not asked:
        return docs.sparkSession.createDataFrame([], "gram string, fold boolean, doc_id long")
    texts = docs.select("doc_id", "text", F.lower("text").alias("low"))  # lower() changes more than A-Z, but leaves every a-z
    has = [F.when(F.col("low" if fold else "text").contains(g), F.struct(F.lit(g).alias("gram"), F.lit(fold).alias("fold"))) for g, fold in asked]
    return texts.select("doc_id", F.explode(F.array_compact(F.array(*has))).alias("g")).select("g.gram", "g.fold", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, kinds``: the rules of which some branch has all its postings at the document."""
    asked = [(r.kind, n, g, r.fold, len(b)) for r in rules for n, b in enumerate(branches(r)) for g in sorted(b)]
    query = index.sparkSession.createDataFrame(asked, "kind string, branch int, gram string, fold boolean, need int")
    met = index.join(F.broadcast(query), ["gram", "fold"])  # the rules alone
    whole = met.groupBy("doc_id", "kind", "branch").agg(F.countDistinct("gram").alias("n"), F.first("need").alias("need")).where("n = need")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # at most one entry per rule


def found(rule: Rule, text: Column) -> Column:
    """The rule's spans in a text, as an array of start, end, place in the list of rules and kind.

    Leftmost, not overlapping; a match whose group is too short is used up, but not a span. The
    text between matches and the matches themselves, laid end to end, give the positions.
    """
    pattern, place = F.lit(java_pattern(rule)), RULES.index(rule) if rule in RULES else len(RULES)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.slice(F.split(text, java_pattern(rule), -1), F.lit(1), F.size(match))
    parts = F.arrays_zip(match.alias("m"), group.alias("g"), between.alias("b"))
    kind = "array<struct<start:int,end:int,place:int,kind:string>>"

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + F.char_length(part["b"])
        end = start + F.char_length(part["m"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"))).cast(kind)
        keep = F.char_length(part["g"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(parts, start, step, lambda x: x["spans"])).otherwise(F.array().cast(kind))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs`` (doc_id, text); spans sorted by start, then place of the rule.

    A null text is an empty one; an empty text has no spans. A null doc_id or one that several
    rows share is allowed: candidates of one are candidates of all, and each row is searched by
    itself. Other columns are not looked at; no rows give no rows. Offsets are code points, the
    end exclusive.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    all_texts = [r for r in rules if not branches(r)]
    some = staged(candidates(postings(texts, rules), rules))  # a table of known size: Spark broadcasts it only if it is small
    joined = texts.join(some.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    per_rule = [
        found(r, F.col("text")) if r in all_texts else F.when(F.array_contains("kinds", r.kind), found(r, F.col("text"))).otherwise(F.array().cast("array<struct<start:int,end:int,place:int,kind:string>>"))
        for r in rules
    ]
    ordered = F.array_sort(F.flatten(F.array(*per_rule)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]))
    return joined.select("doc_id", ordered.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found_spans: DataFrame) -> DataFrame:
    """``doc_id``, counts and digest of the base kinds, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_spans.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same spans in DuckDB's SQL: every rule over every text."""
    parts = []
    for place, rule in enumerate(RULES):
        # DuckDB's engine stops at 1,000 repeats, none of the rules comes near that
        pattern = java_pattern(rule).replace("'", "''")
        parts.append(f"select doc_id, text, {place} as place, '{rule.kind}' as kind, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {rule.group}) as g, string_split_regex(text, '{pattern}') as b, {rule.least} as least from texts")
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
matched as ({' union all '.join(parts)}),
each_match as (select *, unnest(range(1, len(m) + 1)) as i from matched),
spans as (
  select doc_id, place, kind, start, start + length(m[i]) as stop from (
    select *, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as start from each_match)
  where length(g[i]) >= least),
joined as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (kind in ({base})) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (doc_id)"""


ORACLE = _oracle()
