"""Code maps, cleaned measures and feature columns. All are column expressions or joins with a small dimension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators._names import spare


def literal_map(values: dict) -> Column:
    """A caller's dictionary as a map column; lookups of unknown or null keys give null."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def map_codes_effective_dated(df: DataFrame, code: str, aliases: DataFrame, out: str, period: str | None = None) -> DataFrame:
    """Id of a code from aliases (alias, id, valid_to), trimmed and without case; unknown or null codes give null.

    A row with ``valid_to`` holds for periods up to it, the earliest such row first, and the open row after that.
    Without a period, or where it is null, only open rows count. Each code is one row after the aliases are folded,
    so the number of rows stays.
    """
    key, dated, open_ = spare(df, "key", "dated", "open")
    norm = lambda c: F.upper(F.trim(c))
    ends = F.when(F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("to"), F.col("id").alias("id")))
    dim = aliases.groupBy(norm(F.col("alias")).alias(key)).agg(F.array_sort(F.collect_list(ends)).alias(dated), F.min(F.when(F.col("valid_to").isNull(), F.col("id"))).alias(open_))
    joined = df.join(dim, norm(F.col(code)) == F.col(key), "left")
    current = F.lit(None) if period is None else F.try_element_at(F.filter(dated, lambda d: d["to"] >= F.col(period)), F.lit(1))["id"]
    return joined.select(*df.columns, F.coalesce(current, F.col(open_)).alias(out))


def split_multi_code(df: DataFrame, col: str, ids: dict, sep: str = "/") -> DataFrame:
    """Adds n_codes, code_ids (null if any part is unknown) and code_id (only when there is one part); null text gives nulls."""
    parts = F.transform(F.split(col, f"\\Q{sep}\\E"), F.trim)
    found = F.transform(parts, lambda p: looked_up(ids, p))
    known = F.forall(found, lambda i: i.isNotNull())
    return df.withColumns({"n_codes": F.when(F.col(col).isNotNull(), F.size(parts)), "code_ids": F.when(known, found), "code_id": F.when(known & (F.size(parts) == 1), found[0])})


def map_first_of(df: DataFrame, columns: list[str], groups: dict, out: str, sep: str = "/", prefix: str = "") -> DataFrame:
    """Group of the first column that maps; multi-part codes count by their first part, an optional prefix is stripped."""

    def one(c: str) -> Column:
        return looked_up(groups, F.regexp_replace(F.trim(F.split(c, f"\\Q{sep}\\E")[0]), f"^\\Q{prefix}\\E", ""))

    return df.withColumn(out, F.coalesce(*[one(c) for c in columns]))


def refine_within_parent(df: DataFrame, sources: list[tuple[str, str]], generic: str, parent: str, level: str) -> DataFrame:
    """Parent of the first source with one; its level, refined by later sources of the same parent while it is generic or null.

    ``sources`` are (parent column, level column) in order of trust; ``generic`` is the level that may be refined.
    """
    top = F.coalesce(*[F.col(p) for p, _ in sources])
    fine = F.coalesce(*[F.when((F.col(p) == top) & (F.col(v) != generic), F.col(v)) for p, v in sources])
    plain = F.coalesce(*[F.when(F.col(p) == top, F.col(v)) for p, v in sources])
    return df.select("*", top.alias(parent), F.coalesce(fine, plain).alias(level))


def clean_range(df: DataFrame, limits: dict[str, tuple[float | None, float | None]], flag: str = "_suspect") -> DataFrame:
    """Values outside [lo, hi] (None: no limit) become null, with a 0/1 column ``<name><flag>``; null and NaN are not suspect but null."""
    out = {}
    for c, (lo, hi) in limits.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        nan = F.isnan(F.col(c).cast("double"))
        out[c] = F.when(~bad & ~nan, F.col(c))
        out[c + flag] = F.coalesce(bad & ~nan, F.lit(False)).cast("int")
    return df.withColumns(out)


def parse_measure_string(col: Column, factor: float = 12, sep: str = "-") -> Column:
    """"6-2" as 6 * factor + 2; anything else is null."""
    pattern = rf"^\s*(\d+)\Q{sep}\E(\d+(?:\.\d+)?)\s*$"
    major, minor = (F.regexp_extract(col, pattern, i).try_cast("double") for i in (1, 2))
    return major * factor + minor


def lookup_candidates(df: DataFrame, keys: list[Column], table: DataFrame, key: str, catch_all: str, out: str) -> DataFrame:
    """The first candidate key of a row that stands in the table (one column ``key``), else ``catch_all``; adds ``matched``.

    Candidates go to the table's keys in one join and come back by the smallest place; null candidates are passed over.
    """
    row, at, k = spare(df, "row", "at", "k")
    rows = df.withColumn(row, F.struct(*df.columns))
    tried = rows.select(row, F.posexplode(F.array(*keys)).alias(at, k))
    hits = tried.join(table.select(F.col(key).alias(k)).distinct().withColumn("hit", F.lit(True)), k, "left")
    first = hits.groupBy(row).agg(F.min(F.when(F.col("hit"), F.struct(at, k))).alias("best"), (F.count("*") / len(keys)).cast("long").alias("n"))
    found = first.select(f"{row}.*", F.coalesce(F.col("best")[k], F.lit(catch_all)).alias(out), F.col("best").isNotNull().cast("int").alias("matched"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias(at))
    return found.drop(at)


def unpivot_home_away(df: DataFrame, pairs: dict[str, tuple[str, str]], signed: list[str], score: str | None = None) -> DataFrame:
    """Two rows of each row: for each pair (name: home column, away column) ``name`` and ``opp_name``; signed columns change sign for away.

    With ``score`` (a name of pairs) also won, lost and tied; a null on either side gives nulls. Other columns are repeated.
    """
    used = {c for p in pairs.values() for c in p}
    rest = [c for c in df.columns if c not in used and c not in signed]

    def side(home: bool) -> Column:
        own, other = (0, 1) if home else (1, 0)
        cells = [F.lit(int(home)).alias("is_home")]
        for n, p in pairs.items():
            cells += [F.col(p[own]).alias(n), F.col(p[other]).alias(f"opp_{n}")]
        return F.struct(*cells, *[(F.col(c) if home else -F.col(c)).alias(c) for c in signed])

    out = df.select(*rest, F.inline(F.array(side(True), side(False))))
    if score is None:
        return out
    a, b = F.col(score), F.col(f"opp_{score}")
    return out.withColumns({"won": (a > b).cast("int"), "lost": (a < b).cast("int"), "tied": (a == b).cast("int")})


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is null or zero."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def derived_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]], power: dict[str, tuple[str, str]] | None = None, exponent: float = 2.37) -> DataFrame:
    """Ratios of (already summed) components, and x^e / (x^e + y^e) for the pairs of ``power``."""
    out = {n: ratio(F.col(a), F.col(b)) for n, (a, b) in ratios.items()}
    for n, (a, b) in (power or {}).items():
        x, y = F.pow(a, F.lit(exponent)), F.pow(b, F.lit(exponent))
        out[n] = ratio(x, x + y)
    return df.withColumns(out)


def american_probability(odds: Column) -> Column:
    return F.when(odds < 0, -odds / (100 - odds)).when(odds > 0, F.lit(100.0) / (odds + 100))


def implied_probability(df: DataFrame, home: str, away: str, spread: str) -> DataFrame:
    """p_home without the margin of two-sided odds; else by logit(p) = b * spread, b fitted through the origin on rows with both.

    Adds p_home, p_source (odds, spread or null), b and rmse of the fit in probabilities. b is one aggregate, sent
    back to every row as a single-row join.
    """
    h, a = american_probability(F.col(home)), american_probability(F.col(away))
    (p,) = spare(df, "p")
    rows = df.withColumn(p, h / (h + a))
    logit = F.log(F.col(p) / (1 - F.col(p)))
    both = rows.where(F.col(p).isNotNull() & F.col(spread).isNotNull() & (F.col(p) > 0) & (F.col(p) < 1))
    fit = both.agg(F.try_divide(F.sum(F.col(spread) * logit), F.sum(F.col(spread) * F.col(spread))).alias("b"))
    by_line = 1 / (1 + F.exp(-F.col("b") * F.col(spread)))
    rmse = both.join(F.broadcast(fit)).agg(F.sqrt(F.avg(F.pow(F.col(p) - by_line, 2))).alias("rmse"))
    out = rows.join(F.broadcast(fit)).join(F.broadcast(rmse))
    source = F.when(F.col(p).isNotNull(), "odds").when(by_line.isNotNull(), "spread")
    return out.select(*df.columns, F.coalesce(F.col(p), by_line).alias("p_home"), source.alias("p_source"), "b", "rmse")


def fill_missing_flag(df: DataFrame, columns: list[str], base: str | None = None, suffix: str = "_miss") -> DataFrame:
    """Zero-fills columns and adds 0/1 flags; a flag that is constant, or equal to the flag of ``base`` on every row, is left out.

    Which flags say anything is one aggregate over all rows.
    """
    missing = {c: F.col(c).isNull().cast("int") for c in columns}
    cells = [x for c, m in missing.items() for x in (F.min(m).alias(f"lo{c}"), F.max(m).alias(f"hi{c}"), F.max(F.lit(0) if base in (None, c) else (m != missing[base]).cast("int")).alias(f"ne{c}"))]
    seen = df.agg(*cells).first()
    useful = [c for c in columns if seen[f"lo{c}"] != seen[f"hi{c}"] and (base in (None, c) or seen[f"ne{c}"] == 1)]
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns}
    return df.withColumns(filled | {c + suffix: missing[c] for c in useful})


def bin_values(col: Column, breaks: list[float], labels: list[str]) -> Column:
    """Label i for values below breaks[i] and not below breaks[i-1]; the last label from the last break on; null and NaN stay null."""
    if len(labels) != len(breaks) + 1 or sorted(breaks) != list(breaks):
        raise ValueError("breaks must ascend and labels be one more")
    out = F.when(col.isNull() | F.isnan(col.cast("double")), F.lit(None))
    for b, text in zip(breaks, labels, strict=False):
        out = out.when(col < b, text)
    return out.otherwise(labels[-1])


def dummies(levels: list, col: str, reference, prefix: str) -> dict[str, Column]:
    """0/1 columns of the levels but the reference; null gives null."""
    return {f"{prefix}{v}": (F.col(col) == F.lit(v)).cast("int") for v in levels if v != reference}


def expand_dummies(df: DataFrame, col: str, reference=None, levels: list | None = None, prefix: str | None = None, limit: int = 1000) -> DataFrame:
    """A 0/1 column for each level but the reference (the most frequent, ties: the smallest); rows of unlisted levels raise.

    Levels come from one count; more than ``limit`` of them raise, as columns can't be that many.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(limit + 1).collect()
    if len(counts) > limit:
        raise ValueError(f"{col} has over {limit} levels")
    found = [r[0] for r in counts]
    if levels is not None and set(found) - set(levels):
        raise ValueError(f"{col} has unlisted levels")
    reference = found[0] if reference is None and found else reference
    return df.withColumns(dummies(sorted(levels or found), col, reference, prefix if prefix is not None else f"{col}_"))


def build_control_design(df: DataFrame, controls: list[dict], blocks: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Control columns x * 1{group in groups} from a dictionary of (block, name, column, group, groups); groups None: all rows.

    Returns the frame and the names of the new columns. Rows outside the groups get 0, a null x or group a null.
    """
    new = {}
    for c in controls:
        if blocks is not None and c["block"] not in blocks:
            continue
        x = F.col(c["column"]).cast("double")
        new[c["name"]] = x if c.get("groups") is None else x * F.col(c["group"]).isin(c["groups"]).cast("double")
    return df.withColumns(new), list(new)


def varying_columns(df: DataFrame, columns: list[str], by: list[str] | None = None) -> list[str]:
    """Columns that take two values or more: in the table, or inside some group of ``by``. One aggregate."""
    per = df.groupBy(*(by or [])).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns])
    row = per.agg(*[F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 1]


def drop_constant_columns(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Drops those of ``columns`` that never vary, and of columns equal on every row all but the first.

    Two aggregates: ranges, then equality of the pairs whose ranges and sums agree.
    """
    kept = varying_columns(df, columns, by)
    sums = df.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(c) for c in kept]).first() if kept else {}
    first: dict = {}
    for c in kept:
        first.setdefault((df.schema[c].dataType.simpleString(), sums[c]), c)
    alike = [(first[(df.schema[c].dataType.simpleString(), sums[c])], c) for c in kept]
    pairs = [(a, b) for a, b in alike if a != b]
    same = df.agg(*[F.max((~F.col(a).eqNullSafe(F.col(b))).cast("int")).alias(b) for a, b in pairs]).first() if pairs else {}
    gone = [c for c in columns if c not in kept] + [b for _, b in pairs if same[b] == 0]
    return df.drop(*gone)


def select_measure(df: DataFrame, measure: str, names: list[str], coverage: str | None = None, minimum: float = 0.8) -> DataFrame:
    """Renames ``<measure>_<name>`` to ``<name>``; below the minimum of the ``<measure>_<coverage>`` share the values are null."""
    known = F.lit(True) if coverage is None else F.col(f"{measure}_{coverage}") >= minimum
    return df.withColumns({n: F.when(known, F.col(f"{measure}_{n}")) for n in names})


def apply_policy_registry(df: DataFrame, registry: list[dict], period: str, timing: str = "first") -> DataFrame:
    """0/1 columns of registry rows (indicator, first_season, first_full, last_season) in force; null periods give null.

    ``timing`` "first" counts from first_season, "full" from first_full; an open end holds. ``era`` names the last
    indicator begun, null before all. The registry is a short list of the caller, so it becomes expressions, not a join.
    """
    t, new, begun = F.col(period), {}, []
    for r in sorted(registry, key=lambda r: (r["first_season"], r["indicator"])):
        start = r["first_season"] if timing == "first" else r["first_full"]
        on = t >= start
        begun.append(F.when(on, r["indicator"]))
        new[r["indicator"]] = (on if r.get("last_season") is None else on & (t <= r["last_season"])).cast("int")
    return df.withColumns(new | {"era": F.coalesce(*reversed(begun))})


def classify_by_rules(
    df: DataFrame, key: list[str], text: str, rules: DataFrame, sep: str = "[/,]", joiner: str | None = None, standalone: list[str] | None = None,
    whole: str | None = None, interim: str | None = None, head: list[str] | None = None, once: bool = False,
) -> DataFrame:
    """One row for each fragment of a text: its place, the first rule (rule_order, pattern, code, rank) that it matches, is_primary.

    Patterns are regular expressions without case. Fragments without a rule have code null; is_primary marks the fragment
    of smallest (rank, place), classified ones first. Keys with null or blank text are left out. The rules are folded into
    one array on a single row, so fragments meet them without a shuffle.

    ``joiner`` (" and ", "&") parts a fragment further, but only where a piece by itself has a code of ``standalone`` and the
    fragment doesn't match ``whole``. ``interim`` is taken out of the text and marked in a column of that name: on fragments
    with a code of ``head`` if the text has one, else on all. ``once`` keeps the first fragment of each code of a text.
    """
    (at,) = spare(df.select(*key), "rules")
    folded = rules.agg(F.array_sort(F.collect_list(F.struct("rule_order", "pattern", "code", "rank"))).alias(at))
    hit = lambda f: F.try_element_at(F.filter(F.col(at), lambda r: F.rlike(F.lower(f), F.lower(r["pattern"]))), F.lit(1))
    body = F.col(text) if interim is None else F.regexp_replace(F.col(text), f"(?i){interim}", "")
    parts = F.split(body, sep)
    if joiner is not None:
        alone = F.array(*[F.lit(c) for c in standalone or []]).cast("array<string>")

        def pieces(f: Column) -> Column:
            some = F.filter(F.split(f, joiner), lambda p: F.trim(p) != "")
            apart = (F.size(some) > 1) & F.exists(some, lambda p: F.array_contains(alone, F.coalesce(hit(F.trim(p))["code"], F.lit(""))))
            return F.when(apart if whole is None else apart & ~F.rlike(F.lower(f), F.lower(F.lit(whole))), some).otherwise(F.array(f))

        parts = F.flatten(F.transform(parts, pieces))
    marks = [] if interim is None else [F.rlike(F.lower(F.col(text)), F.lower(F.lit(interim))).cast("int").alias("interim")]
    rows = df.join(F.broadcast(folded)).select(*key, *marks, at, F.posexplode(parts).alias("place", "fragment")).withColumn("fragment", F.trim("fragment")).where("fragment <> ''")
    rows = rows.withColumn("hit", hit(F.col("fragment"))).select(*key, *[c for c in ["interim"] if marks], "place", "fragment", "hit.code", "hit.rank")
    if once:
        first = rows.where("code IS NOT NULL").groupBy(*key, "code").agg(F.min("place").alias("place"))
        rows = rows.where("code IS NULL").unionByName(rows.join(first, [*key, "code", "place"], "left_semi"))
    heads = F.max(F.coalesce(F.col("code").isin(head or []), F.lit(False))).alias("has_head")
    best = rows.groupBy(*key).agg(F.min(F.struct(F.col("rank").isNull().alias("n"), "rank", "place")).alias("b"), heads).select(*key, F.col("b.place").alias("primary_place"), "has_head")
    if marks:
        own = F.when(F.col("has_head"), F.coalesce(F.col("code").isin(head or []), F.lit(False)).cast("int")).otherwise(1)
        marks = [(F.col("interim") * own).alias("interim")]
    return rows.join(best, key).select(*key, "place", "fragment", "code", "rank", *marks, (F.col("place") == F.col("primary_place")).cast("int").alias("is_primary"))


def detect_unrecorded_periods(df: DataFrame, period: str, stats: list[str], share: float = 0.25) -> DataFrame:
    """(stat, period, n_nonzero, median, recorded): a period counts as not recorded below that share of the stat's median over periods."""
    per = df.groupBy(period).agg(*[F.count(F.when(F.col(s) != 0, 1)).alias(s) for s in stats])
    long = per.unpivot([period], stats, "stat", "n_nonzero")
    middle = long.groupBy("stat").agg(F.percentile("n_nonzero", F.lit(0.5)).alias("median"))
    return long.join(middle, "stat").withColumn("recorded", (F.col("n_nonzero") >= share * F.col("median")).cast("int"))


def null_unrecorded(df: DataFrame, period: str, stats: list[str], share: float = 0.25) -> DataFrame:
    """The rows with the values of unrecorded (stat, period) set to null."""
    found = detect_unrecorded_periods(df, period, stats, share).groupBy(period).agg(*[F.min(F.when(F.col("stat") == s, F.col("recorded"))).alias(f"_rec_{s}") for s in stats])
    joined = df.join(found, period, "left")
    return joined.select(*[F.when(F.col(f"_rec_{c}") == 1, F.col(c)).alias(c) if c in stats else F.col(c) for c in df.columns])


def flag_array_categories(df: DataFrame, col: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """For each name (pattern, exclusion): ``<name>_hits``, the matching entries, and ``<name>``, 1 if there are any; null arrays give null."""

    def hits(pattern: str, but: str | None) -> Column:
        keep: Callable = lambda x: x.rlike(pattern) if but is None else x.rlike(pattern) & ~x.rlike(but)
        return F.filter(col, keep)

    found = {f"{n}_hits": hits(*p) for n, p in patterns.items()}
    return df.withColumns(found | {n: F.when(F.col(col).isNotNull(), (F.size(found[f"{n}_hits"]) > 0).cast("int")) for n in patterns})

