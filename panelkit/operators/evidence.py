"""Statements found in texts: sentences with dictionary terms and their context, and dated statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators._state import checkpointed

# Abbreviations after which a full stop doesn't end a sentence, and English months.
ABBREVIATIONS = "mr|mrs|ms|dr|jr|sr|st|vs|no|inc|co|corp|prof|gen|sen|rep|gov"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DATE = rf"\b(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}\b"


def sentence_array(text: Column) -> Column:
    """Sentences of a text, trimmed; blank ones are left out. Single capitals and abbreviations before a full stop don't end one."""
    safe = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({ABBREVIATIONS}|[a-z])\.(?=\s)", "$1\u0001")
    parts = F.split(safe, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def extract_candidate_sentences(docs: DataFrame, key: str, text: str, terms: dict[str, str], noisy: list[str], subject: str | None = None, section: str = "\n+") -> DataFrame:
    """Sentences that hold a term: key, section, sentence number, sentence, previous, next, terms, groups, noisy_only.

    ``terms`` map a word or phrase to its group; ``noisy`` names groups that say little alone. Sentences whose only term is
    the row's ``subject`` column are left out. Context comes from the section's own array, so nothing is shuffled. Null texts give no rows.
    """
    listed = F.array(*[F.struct(F.lit(t.lower()).alias("t"), F.lit(g).alias("g")) for t, g in terms.items()])
    name = F.lit(None).cast("string") if subject is None else F.lower(F.col(subject))
    parts = docs.select(F.col(key), name.alias("_subject"), F.posexplode(F.split(text, section)).alias("section", "_part"))
    rows = parts.withColumn("_all", sentence_array(F.col("_part"))).select(key, "_subject", "section", "_all", F.posexplode("_all").alias("number", "sentence"))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("sentence"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    rows = rows.withColumn("_padded", padded).withColumn("_hits", F.filter(listed, lambda x: F.contains(F.col("_padded"), F.concat(F.lit(" "), x["t"], F.lit(" ")))))
    names = F.transform("_hits", lambda x: x["t"])
    real = F.filter(names, lambda x: ~x.eqNullSafe(F.col("_subject")))
    groups = F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["g"])))
    rows = rows.where(F.size(real) > 0)
    return rows.select(
        key, "section", "number", "sentence", F.try_element_at("_all", F.nullif(F.col("number"), F.lit(0))).alias("previous"), F.try_element_at("_all", F.col("number") + 2).alias("next"),
        F.array_sort(names).alias("terms"), groups.alias("groups"), (F.size(F.array_except(groups, F.array(*map(F.lit, noisy)).cast("array<string>"))) == 0).cast("int").alias("noisy_only"),
    )


def word_grams(text: Column, longest: int) -> Column:
    """The different runs of one to ``longest`` words of a text, lower case, joined by one space."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    every = [F.when(F.size(words) >= k, runs(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)]
    return F.array_distinct(F.concat(*every))


def extract_dated_statements(docs: DataFrame, key: str, text: str, verb: str, exclude: str, entities: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Sentences with exactly one written date, a required verb, no exclusion pattern and one entity (name, entity_id): dated rows with their kind.

    ``kinds`` map a kind to a pattern, the first that holds wins, else "other". The sentences' word runs, as long as the
    longest name, are joined with the names, so there may be any number of them; names with other than letters, digits and
    single spaces are found nowhere. Repeated documents give their rows again; dates that don't exist give no row.
    """
    spaced = F.col("name").isNotNull() & ~F.lower("name").rlike(r"[^\p{L}\p{N} ]|^ | $|  ") & (F.col("name") != "")
    names = entities.where(spaced).groupBy(F.lower("name").alias("_gram")).agg(F.min("entity_id").alias("_least"), F.max("entity_id").alias("_most"))
    longest = names.agg(F.coalesce(F.max(F.size(F.split("_gram", " "))), F.lit(1))).first()[0]
    rows = docs.select(F.col(key), F.posexplode(sentence_array(F.col(text))).alias("number", "sentence"))
    dates = F.regexp_extract_all("sentence", F.lit(f"({DATE})"), 1)
    rows = rows.withColumn("_dates", F.array_distinct(dates)).where((F.size("_dates") == 1) & F.col("sentence").rlike(verb) & ~F.col("sentence").rlike(exclude))
    rows = checkpointed(rows.withColumn("_id", F.monotonically_increasing_id()))
    met = rows.select("_id", F.explode(word_grams(F.col("sentence"), longest)).alias("_gram")).join(names, "_gram")
    one = met.groupBy("_id").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most")).where("_least = _most")
    kind = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.lit(k)) for k, p in kinds.items()], F.lit("other"))
    day = F.to_date(F.try_to_timestamp(F.col("_dates")[0], F.lit("MMMM d, yyyy")))
    return rows.join(one, "_id").select(key, "number", F.col("_least").alias("entity_id"), day.alias("date"), kind.alias("kind"), "sentence").where("date IS NOT NULL")
