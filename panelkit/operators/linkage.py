"""Entity linkage: blocked candidates, tiers, crosswalks, adoption of ids and reconciliation of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import jaro_winkler
from panelkit.operators._names import refuse
from panelkit.operators._pairs import linked_pairs
from panelkit.operators.joins import anti, distinct_from, semi


#: Letters from rare to frequent in names; others count as rarer still.
RARE_FIRST = "qxzjvwkfpbgycmhduotslrniea"


def _first_name_keys(name: Column, min_similarity: float) -> Column:
    """Keys of which two names share one if their Jaro-Winkler similarity reaches ``min_similarity`` (0.7 to 1).

    Names with the same first letter share that key. Others have no common prefix, so their Jaro similarity itself is
    s = min_similarity or more: with lengths a, b and m letters in common m / a + m / b >= 3 s - 1, and as m is at most the
    shorter length, m >= (3 s - 2) a. Two such names then share one of each's rarest a - m + 1 letters, counted with repeats.
    """
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c))))
    order = F.transform(numbered, lambda x: F.struct(F.instr(F.lit(RARE_FIRST), F.substring(x, 1, 1)).alias("o"), x.alias("x")))
    needed = F.ceil((3 * min_similarity - 2) * F.size(letters) - 1e-9)
    rare = F.slice(F.array_sort(order), F.lit(1), F.greatest(F.size(letters) - needed.cast("int") + 1, F.lit(0)))
    return F.array_append(F.transform(rare, lambda o: o["x"]), F.concat(F.lit("^"), F.substring(name, 1, 1)))


def block_fuzzy_pairs(a: DataFrame, b: DataFrame, block: str, first: str, a_id: str, b_id: str, min_prefix: int = 3, min_similarity: float = 0.85) -> DataFrame:
    """(a_id, b_id, how) of rows with equal blocking key whose first names agree: equal, prefix (of min_prefix letters or more) or similar.

    Different names of a block are compared, not rows: prefixes meet on the cut name, similar names under keys that are
    complete for the similarity, so a block is split by key and never met as all pairs. Each pair comes once, with its
    strongest reason; rows with a null block or name are in none. The pairs found, whose number grows with the square of the
    rows of a name, are made by the last step and not shuffled, but for those of ids with several names.
    """
    if not 0.7 < min_similarity <= 1:
        raise ValueError("keys are complete for similarities above 0.7 only")
    l = a.select(F.col(a_id), F.col(block).alias("_k"), F.col(first).alias("_fa")).where("_k IS NOT NULL AND _fa IS NOT NULL")
    r = b.select(F.col(b_id), F.col(block).alias("_k"), F.col(first).alias("_fb")).where("_k IS NOT NULL AND _fb IS NOT NULL")
    na, nb = l.select("_k", "_fa").distinct(), r.select("_k", "_fb").distinct()

    def cuts(names: DataFrame, name: str) -> DataFrame:
        whole = F.length(name)
        starts = F.when(whole >= min_prefix, F.transform(F.sequence(F.lit(min_prefix), whole), lambda n: F.substring(F.col(name), F.lit(1), n))).otherwise(F.array().cast("array<string>"))
        return names.select("_k", name, F.explode(starts).alias("_cut"))

    equal = na.join(nb, (na["_k"] == nb["_k"]) & (F.col("_fa") == F.col("_fb"))).select(na["_k"], "_fa", "_fb", F.lit(1).alias("_s"))
    parts = [x.join(y, ["_k", "_cut"]).where(F.col("_fa") != F.col("_fb")).select("_k", "_fa", "_fb", F.lit(2).alias("_s")) for x, y in ((cuts(na, "_fa"), nb.withColumn("_cut", F.col("_fb"))), (na.withColumn("_cut", F.col("_fa")), cuts(nb, "_fb")))]
    keyed = [x.select("_k", n, F.explode(_first_name_keys(F.col(n), min_similarity)).alias("_key")) for x, n in ((na, "_fa"), (nb, "_fb"))]
    shortest, longest = F.least(F.length("_fa"), F.length("_fb")), F.greatest(F.length("_fa"), F.length("_fb"))
    # With four letters of common prefix the Jaro part is (s - 0.4) / 0.6 or more, and so the lengths' ratio 3 times that less 2.
    ratio = 3 * (min_similarity - 0.4) / 0.6 - 2
    met = keyed[0].join(keyed[1], ["_k", "_key"]).where((F.col("_fa") != F.col("_fb")) & (shortest >= ratio * longest)).select("_k", "_fa", "_fb").distinct()
    near = met.where(jaro_winkler("_fa", "_fb") >= min_similarity).withColumn("_s", F.lit(3))
    names = reduce(DataFrame.union, [equal, *parts, near]).groupBy("_k", "_fa", "_fb").agg(F.min("_s").alias("_s"))
    found = linked_pairs(l, r, a_id, b_id, names, "_s")
    return found.select(a_id, b_id, F.when(F.col("_s") == 1, "exact").when(F.col("_s") == 2, "prefix").otherwise("similar").alias("how"))


def link_validated_ids(pairs: DataFrame, checks: dict[str, Column], needed: list[list[str]]) -> DataFrame:
    """Evidence rows (a, b, path) -> one row per pair: its paths, the checks, kept.

    ``checks`` are conditions on evidence rows, true if any row says so. A pair is kept where every group of ``needed``
    has a check that holds; the checks are waived where two different paths agree.
    """
    rows = pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("path")).alias("paths"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    holds = reduce(lambda x, y: x & y, [reduce(lambda x, y: x | y, [F.col(n) for n in group]) for group in needed])
    return rows.withColumn("kept", holds | (F.size("paths") >= 2))


def link_tiered(candidates: DataFrame, held: DataFrame | None = None, span: int = 6) -> DataFrame:
    """Candidates (a, b, tier, exact, seasons) -> links (a, b, tier, confidence).

    Only a's best tier counts. It keeps one candidate, or several whose seasons are disjoint fragments within ``span``
    years; else the exact ones under the same rule. Then b claimed by two a, or held by a link of ``held`` (a, b), goes.
    Confidence is high for an exact link of tier 1 that needed no choice. Seasons are counted exploded, not as lists.
    """
    best = candidates.groupBy("a").agg(F.min("tier").alias("_t"))
    rows = candidates.join(best, "a").where("tier = _t").drop("_t")
    years = rows.select("a", "exact", F.explode_outer("seasons").alias("s"))

    def stats(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("a").agg((F.count("s") == F.countDistinct("s")).alias(f"apart{tag}"), (F.max("s") - F.min("s") < span).alias(f"near{tag}"))

    counts = rows.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("exact"), 1)).alias("n_exact"))
    rows = rows.join(counts, "a").join(stats(years, ""), "a").join(stats(years.where("exact"), "_e"), "a", "left")
    whole = (F.col("n") == 1) | F.coalesce(F.col("apart") & F.col("near"), F.lit(False))
    part = F.col("exact") & ((F.col("n_exact") == 1) | F.coalesce(F.col("apart_e") & F.col("near_e"), F.lit(False)))
    rows = rows.where(whole | part).select("a", "b", "tier", F.when((F.col("tier") == 1) & F.col("exact") & whole, "high").otherwise("medium").alias("confidence"))
    claims = rows.groupBy("b").agg(F.countDistinct("a").alias("n")).where("n = 1").select("b")
    rows = rows.join(claims, "b").select("a", "b", "tier", "confidence")
    return rows if held is None else anti(rows, held, ["b"])


def unambiguous(dim: DataFrame, key: str, entity: str) -> DataFrame:
    """(key, entity) of keys that mean one entity only."""
    one = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(entity).alias(entity), F.max(entity).alias("_hi"))
    return one.where(F.col(entity) == F.col("_hi")).select(key, entity)


def xwalk_string_levels(strings: DataFrame, col: str, levels: list[tuple[str, Column, DataFrame]], overrides: DataFrame | None = None) -> DataFrame:
    """(string, entity, level) of distinct strings: an override, else the first of ``levels`` (name, key of the string, (key, entity)) with an unambiguous key.

    A blank override blocks the string (level "blocked"); strings without a level stay as "unmapped".
    """
    rows = strings.select(F.col(col).alias("string")).where("string IS NOT NULL").distinct()
    if overrides is not None:
        rows = rows.join(overrides.groupBy("string").agg(F.min("entity").alias("_o"), F.count("*").alias("_has")), "string", "left")
    else:
        rows = rows.withColumns({"_o": F.lit(None).cast("string"), "_has": F.lit(None).cast("long")})
    for i, (_, key, dim) in enumerate(levels):
        known = unambiguous(dim.toDF("_key", f"_e{i}"), "_key", f"_e{i}")
        rows = rows.withColumn("_key", key).join(known, "_key", "left").drop("_key")
    entity = F.when(F.col("_has").isNotNull(), F.nullif("_o", F.lit(""))).otherwise(F.coalesce(*[F.col(f"_e{i}") for i in range(len(levels))]))
    level = F.when(F.col("_has").isNotNull(), F.when(F.nullif("_o", F.lit("")).isNull(), "blocked").otherwise("override"))
    for i, (name, _, _) in enumerate(levels):
        level = level.when(F.col(f"_e{i}").isNotNull(), name)
    return rows.select("string", entity.alias("entity"), level.otherwise("unmapped").alias("level"))


def xwalk_primary(links: DataFrame, master: str, other: str, order: list[Column], method: str, period: str, flags: dict[str, Column]) -> DataFrame:
    """One row per master id: primary (smallest by ``order``, then the id), all ids and methods sorted, first and last period, any-of flags."""
    return links.groupBy(master).agg(
        F.min_by(other, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], other)).alias("primary_id"),
        F.array_sort(F.collect_set(other)).alias("all_ids"),
        F.array_sort(F.collect_set(method)).alias("methods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()],
    )


def link_transitive(ab: DataFrame, bc: DataFrame, direct: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """(a, c, confidence, via): links a-b and b-c, each with a confidence (smaller is better), give a-c with the worse of both.

    The best path of a pair counts; ``direct`` (a, c, confidence) is used only for a without such a path. Where these rows
    are all a and c of equal ``by``, two frames (a, by) and (by, c, confidence) stand for them: a with a path go before
    pairs are made, and pairs, whose number grows with the square of a group, are made by the last step and not shuffled,
    but for those of ids with several groups or confidences.
    """
    left, right = ab.select("a", "b", F.col("confidence").alias("_x")), bc.select("b", "c", F.col("confidence").alias("_y"))
    paths = left.join(right, "b").groupBy("a", "c").agg(F.min(F.greatest("_x", "_y")).alias("confidence")).withColumn("via", F.lit("path"))
    linked = semi(ab.select("a", "b"), bc, ["b"]).select("a").distinct()
    if isinstance(direct, DataFrame):
        rest = anti(direct, linked, ["a"]).groupBy("a", "c").agg(F.min("confidence").alias("confidence"))
    else:
        free = anti(direct[0].select("a", F.col("by").alias("_by")), linked, ["a"]).where("_by IS NOT NULL")
        ends = direct[1].where("by IS NOT NULL").groupBy(F.col("by").alias("_by"), "c").agg(F.min("confidence").alias("_y"))
        rest = linked_pairs(free, ends, "a", "c", ends.select("_by", "_y").distinct().withColumn("confidence", F.col("_y")), "confidence")
    return paths.unionByName(rest.withColumn("via", F.lit("direct")))


def adopt_unique_name(entries: DataFrame, name: str, entity: str, group: str, kind: str, period: str, aliases: dict | None = None) -> DataFrame:
    """Adds adopted and how: entries without an id take that of the single linked entity of their name.

    In the same group at once ("same_group"); in another group of the same kind only if that entity isn't listed in the
    period ("other_group"). ``aliases`` map ids to the id that stands for them. Linked entries keep theirs ("linked").
    """
    own = F.col(entity)
    if aliases:
        own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), own), own)
    rows = entries.withColumn("_id", own)
    linked = rows.where("_id IS NOT NULL")
    single = linked.groupBy(F.col(name).alias("_n")).agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo = _hi").select("_n", F.col("_lo").alias("_one"))
    groups = linked.select(F.col(name).alias("_gn"), F.col(group).alias("_gg")).distinct().withColumn("_same", F.lit(True))
    kinds = linked.select(F.col(name).alias("_kn"), F.col(kind).alias("_kk")).distinct().withColumn("_alike", F.lit(True))
    busy = linked.select(F.col("_id").alias("_bi"), F.col(period).alias("_bp")).distinct().withColumn("_busy", F.lit(True))
    out = rows.join(single, F.col(name) == F.col("_n"), "left")
    out = out.join(groups, (F.col(name) == F.col("_gn")) & (F.col(group) == F.col("_gg")), "left").join(kinds, (F.col(name) == F.col("_kn")) & (F.col(kind) == F.col("_kk")), "left")
    out = out.join(busy, (F.col("_one") == F.col("_bi")) & (F.col(period) == F.col("_bp")), "left")
    how = F.when(F.col("_id").isNotNull(), "linked").when(F.col("_one").isNotNull() & F.col("_same"), "same_group").when(F.col("_one").isNotNull() & F.col("_alike") & F.col("_busy").isNull(), "other_group")
    adopted = F.when(F.col("_id").isNotNull(), F.col("_id")).when(how.isNotNull(), F.col("_one"))
    return out.select(*entries.columns, adopted.alias("adopted"), how.alias("how"))


def match_token_overlap(a: Column, b: Column, generic: list[str], min_length: int = 3) -> Column:
    """True if two strings are equal after cleaning or share a distinctive token; null if either is null."""

    def clean(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    def tokens(c: Column) -> Column:
        kept = F.filter(F.split(clean(c), " "), lambda x: F.length(x) >= min_length)
        return F.array_except(kept, F.array(*map(F.lit, generic)).cast("array<string>"))

    return (clean(a) == clean(b)) | F.arrays_overlap(tokens(a), tokens(b))


def reconcile_sources(left: DataFrame, right: DataFrame, key: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """One row per key of either source: status exact, partial, only_left or only_right, n_agree and the names that differ.

    Both sources hold a key once; keys with nulls meet as equal; two nulls agree; numbers agree within ``tolerance``.
    """
    l = left.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(key)], *[F.col(v).alias(f"_lv{i}") for i, v in enumerate(values)], F.lit(True).alias("_in_l"))
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(key)], *[F.col(v).alias(f"_rv{i}") for i, v in enumerate(values)], F.lit(True).alias("_in_r"))
    both = l.join(r, reduce(lambda x, y: x & y, [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(key))]), "full_outer")
    agree = []
    for i, v in enumerate(values):
        x, y = F.col(f"_lv{i}"), F.col(f"_rv{i}")
        numeric = left.schema[v].dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")
        agree.append(F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull()) if numeric else ~distinct_from(x, y))
    n = sum((c.cast("int") for c in agree), F.lit(0))
    status = F.when(F.col("_in_r").isNull(), "only_left").when(F.col("_in_l").isNull(), "only_right").when(n == len(values), "exact").otherwise("partial")
    differ = F.array_join(F.array_compact(F.array(*[F.when(~c, F.lit(v)) for c, v in zip(agree, values, strict=True)])), ",")
    there = F.col("_in_l") & F.col("_in_r")
    return both.select(*[F.coalesce(f"_l{i}", f"_r{i}").alias(k) for i, k in enumerate(key)], status.alias("status"), F.when(there, n).alias("n_agree"), F.when(there, differ).alias("differ"))


def match_ordered(left: DataFrame, right: DataFrame, key: list[str], order: str, name: Column, surname: Column, strict: bool = False) -> DataFrame:
    """Two ordered lists per key, the left one authoritative: key, place, left_row, right_row, how, problem.

    Left entries in their order take a right entry that no earlier one has: of equal ``name``, else of equal ``surname``
    (expressions over both frames' columns); how is exact or surname. Several that fit are "ambiguous" and none is taken. An entry
    without a match is left_only: a note, but a problem ("first unmatched") before any match. Right entries that are
    left are right_only, a problem ("not listed"). place counts matches; rows are structs of the frames' columns. With
    ``strict`` a problem raises. A list is a few entries of one key, so it is folded as one sorted array; ties of order go
    by name; null keys meet.
    """
    def listed(df: DataFrame, side: str) -> DataFrame:
        entry = F.struct(F.col(order).alias("o"), name.alias("n"), surname.alias("s"), F.struct(*df.columns).alias("row"))
        return df.groupBy(*[F.col(k).alias(f"_{side}{i}") for i, k in enumerate(key)]).agg(F.array_sort(F.collect_list(entry)).alias(f"_{side}"))

    l, r = listed(left, "l"), listed(right, "r")
    both = l.join(r, reduce(lambda x, y: x & y, [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(key))]), "full_outer")
    row_l, row_r = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType, right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType
    types = {"rest": r.schema["_r"].dataType, "out": T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("place", T.IntegerType()), ("left_row", row_l), ("right_row", row_r), ("how", T.StringType()), ("problem", T.StringType()))]))}
    start = F.struct(F.coalesce("_r", F.array().cast(types["rest"])).alias("rest"), F.array().cast(types["out"]).alias("out"), F.lit(0).alias("n"))

    def step(state: Column, e: Column) -> Column:
        same = F.filter(state["rest"], lambda x: x["n"] == e["n"])
        near = F.filter(state["rest"], lambda x: x["s"] == e["s"])
        fits = F.when(F.size(same) > 0, same).otherwise(near)
        one = F.size(fits) == 1
        taken = F.get(fits, F.lit(0))
        n = state["n"] + one.cast("int")
        how = F.when(F.size(fits) > 1, "ambiguous").when(~one, "left_only").when(F.size(same) > 0, "exact").otherwise("surname")
        problem = F.when(F.size(fits) > 1, "ambiguous").when(~one & (state["n"] == 0), "first unmatched").otherwise("")
        got = F.struct(F.when(one, n).alias("place"), e["row"].alias("left_row"), F.when(one, taken["row"]).alias("right_row"), how.alias("how"), problem.alias("problem"))
        at = F.array_position(state["rest"], taken)
        rest = F.when(one, F.concat(F.slice(state["rest"], F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(state["rest"], at.cast("int") + 1, F.size(state["rest"])))).otherwise(state["rest"])
        return F.struct(rest.alias("rest"), F.concat(state["out"], F.array(got)).cast(types["out"]).alias("out"), n.alias("n"))

    folded = F.aggregate(F.coalesce("_l", F.array().cast(l.schema["_l"].dataType)), start, step)
    left_over = lambda s: F.transform(s["rest"], lambda x: F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast(row_l).alias("left_row"), x["row"].alias("right_row"), F.lit("right_only").alias("how"), F.lit("not listed").alias("problem")))
    done = both.select(*[F.coalesce(f"_l{i}", f"_r{i}").alias(k) for i, k in enumerate(key)], folded.alias("_s"))
    rows = done.select(*key, F.inline(F.concat(F.col("_s.out"), left_over(F.col("_s")).cast(types["out"]))))
    problem = F.nullif("problem", F.lit(""))
    if strict:
        said = F.concat(F.lit("lists don't match: "), problem, F.lit(" at "), F.to_json(F.struct(*key)))
        problem = F.when(problem.isNotNull(), F.raise_error(said).cast("string"))
    return rows.select(*key, "place", "left_row", "right_row", "how", problem.alias("problem"))


def override_timeline(base: DataFrame, key: list[str], time: str, holder: str, corrections: DataFrame, brackets: DataFrame) -> DataFrame:
    """Adds holder_final, holder_source, unknown_window: dated corrections first, then bracketed changes, else the base.

    ``corrections``: key, after, until (null: open), new_holder; they hold for after < time <= until, the latest ``after``
    wins. ``brackets``: key, seen_old, seen_new, next_holder; from seen_new on the new holder, between both unknown. The
    winner is found for each (key, time) that occurs and joined back, so every base row comes back once, equal ones too.
    """
    refuse(base, "holder_final", "holder_source", "unknown_window")
    at = [f"_k{i}" for i in range(len(key))]
    points = base.select(*[F.col(k).alias(a) for k, a in zip(key, at, strict=True)], F.col(time).alias("_t")).dropna().distinct()
    rename = lambda df: df.select(*[F.col(k).alias(a) for k, a in zip(key, at, strict=True)], *[c for c in df.columns if c not in key])
    inside = (F.col("_t") > F.col("after")) & (F.col("until").isNull() | (F.col("_t") <= F.col("until")))
    fixed = points.join(rename(corrections), at).where(inside).groupBy(*at, "_t").agg(F.max_by("new_holder", F.struct("after", "new_holder")).alias("_fixed"))
    late = F.col("_t") >= F.col("seen_new")
    seen = points.join(rename(brackets), at).where(F.col("_t") > F.col("seen_old")).groupBy(*at, "_t").agg(
        F.max_by(F.when(late, F.col("next_holder")), F.when(late, F.struct("seen_new", "next_holder"))).alias("_next"), F.coalesce(F.bool_or(~late), F.lit(False)).alias("_open")
    )
    changes = fixed.join(seen, [*at, "_t"], "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(a) for k, a in zip([*key, time], [*at, "_t"], strict=True)])
    out = base.join(changes, same, "left")
    source = F.when(F.col("_fixed").isNotNull(), "correction").when(F.col("_next").isNotNull(), "bracket").otherwise("base")
    unknown = F.col("_fixed").isNull() & F.coalesce("_open", F.lit(False))
    return out.select(*base.columns, F.coalesce("_fixed", "_next", holder).alias("holder_final"), source.alias("holder_source"), unknown.cast("int").alias("unknown_window"))


def flag_suspect_links(df: DataFrame, link: str, contradictions: dict[str, Column]) -> DataFrame:
    """Links contradicted by any condition become null; the id moves to suspect_<link>, the reasons to suspect_reason.

    Conditions that are null don't contradict; rows without a link are never suspect.
    """
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in contradictions.items()]))
    bad = F.col(link).isNotNull() & (F.size(reasons) > 0)
    out = df.withColumns({f"suspect_{link}": F.when(bad, F.col(link)), "suspect_reason": F.when(bad, F.array_join(reasons, ","))})
    return out.withColumn(link, F.when(F.col(f"suspect_{link}").isNull(), F.col(link)))
