"""Industries and titles: labels to sectors, titles to industries, title variants and run plans.

Vocabularies are small dimension tables; every match is an equi join on words, so that no title meets the whole
vocabulary, and the best match is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom import vocab

#: Words of a label that say nothing about a sector, and of a title that say nothing about a job.
LABEL_STOPS = ["and", "of", "the", "other", "except", "services", "service", "general"]
GENERIC = ["manager", "supervisor", "lead", "senior", "junior", "associate", "assistant", "director", "specialist", "coordinator", "operator", "worker", "technician"]


def words(c: Column, drop: list[str]) -> Column:
    """Distinct words of a label in the singular, without stop words."""
    every = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0)
    single = F.transform(every, lambda w: F.when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_distinct(F.filter(single, lambda w: ~w.isin(drop)))


def sector_of_label(labels: DataFrame, naics: DataFrame) -> DataFrame:
    """labels(label) and sector: the sector of the same words, else of the best NAICS title that shares half the words.

    Best is most shared words, then fewest in all.  Ties keep a sector only where all tied titles agree on one; a
    parent code tied with its own child gives way; a tied title without a sector leaves the label open.
    """
    spark = labels.sparkSession
    rows = labels.select("label").distinct().withColumn("w", words(F.col("label"), LABEL_STOPS))
    own = spark.createDataFrame([(s,) for s in vocab.SECTORS], "sector string").select("sector", F.array_sort(words(F.col("sector"), LABEL_STOPS)).alias("sw"))
    same = rows.withColumn("sw", F.array_sort("w")).join(own, "sw").select("label", F.col("sector").alias("exact"))
    titles = naics.select("naics_code", "client_industry", words(F.col("naics_title"), LABEL_STOPS).alias("t"))
    hit = rows.select("label", F.size("w").alias("n"), F.explode("w").alias("word")).join(titles.select("naics_code", "client_industry", F.size("t").alias("m"), F.explode("t").alias("word")), "word")
    shared = hit.groupBy("label", "n", "naics_code", "client_industry", "m").agg(F.count("*").alias("shared")).where("2 * shared >= n")
    best = shared.withColumn("r", F.rank().over(Window.partitionBy("label").orderBy(F.col("shared").desc(), F.col("n") + F.col("m") - F.col("shared")))).where("r = 1")
    # a parent goes where its own child is tied with it: children are looked up by their code's prefixes
    child = best.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("naics_code") - 1, F.lit(1))), lambda i: F.substr(F.col("naics_code"), F.lit(1), i))).alias("naics_code"), F.length("naics_code").alias("l")).where(F.length("naics_code") < F.col("l")).select("label", "naics_code").distinct()
    best = best.join(child, ["label", "naics_code"], "left_anti")
    one = best.groupBy("label").agg(F.min("client_industry").alias("lo"), F.max("client_industry").alias("hi"), F.count_if(F.col("client_industry").isNull()).alias("open"))
    out = rows.join(same, "label", "left").join(one, "label", "left")
    return out.select("label", F.coalesce("exact", F.when((F.col("open") == 0) & (F.col("lo") == F.col("hi")), F.col("lo"))).alias("sector"))


def industry_of_title(titles: DataFrame, terms: DataFrame) -> DataFrame:
    """titles(title) and industry: of the same term, else of the longest term of 8 or more letters inside the title.

    Terms are found through their first word, so a title only meets terms that share a word with it.
    """
    t = terms.select(F.lower(F.trim("search_term")).alias("term"), "client_industry", "rank").withColumn("first", F.regexp_extract("term", r"^(\S+)", 1))
    rows = titles.select("title").distinct().withColumn("low", F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\s+", " ")))
    exact = rows.join(t, rows.low == t.term).groupBy("title").agg(F.min_by("client_industry", F.struct("rank", "client_industry")).alias("exact"))
    inside = rows.select("title", "low", F.explode(F.array_distinct(F.split("low", " "))).alias("first")).join(t.where(F.length("term") >= 8), "first")
    inside = inside.where(F.expr("contains(low, term)")).groupBy("title").agg(F.max_by("client_industry", F.struct(F.length("term").alias("a"), (-F.col("rank")).alias("b"))).alias("inside"))
    return rows.join(exact, "title", "left").join(inside, "title", "left").select("title", F.coalesce("exact", "inside").alias("industry"))


def is_searchable(term: Column) -> Column:
    """Whether a term reads like what employers advertise, and not like a classification's label."""
    low, words_ = F.lower(F.coalesce(term, F.lit(""))), F.filter(F.split(F.trim(F.coalesce(term, F.lit(""))), r"\s+"), lambda w: w != "")
    last = F.coalesce(F.try_element_at(words_, F.lit(-1)), F.lit(""))
    label = low.contains(",") | low.contains(" and ") | low.contains("/") | low.rlike("^(?:all other|other )| all other$|except|miscellaneous")
    plural = last.endswith("s") & ~last.rlike("(?:ss|us|is)$")
    return (F.length(low) >= 4) & ~label & F.size(words_).between(1, 4) & ~plural


def clean_title(c: Column, most_words: int = 5) -> Column:
    """A reported job title fit to be a search term, or null: without brackets and odd signs, of few words, not generic, no digits."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)", ""), r"(?U)[^\w\s&/'\-.,()]", " ")
    text = F.regexp_replace(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), r"^[ ,.\-/]+|[ ,.\-/]+$", "")
    unfit = (F.length(text) < 4) | (F.size(F.split(text, " ")) > most_words) | F.lower(text).isin(vocab.STOP_TITLES) | text.rlike(r"\d")
    return F.when(~unfit, text)


def rank_terms(reported: DataFrame, cap: int = 18) -> DataFrame:
    """(soc_code, search_term, rank) from reported(soc_code, part, ord, title): cleaned titles once each, canonical ones (part 0) first, ``cap`` an occupation."""
    rows = reported.withColumn("search_term", clean_title(F.col("title"))).where("search_term is not null and coalesce(soc_code, '') <> ''")
    firsts = rows.groupBy("soc_code", F.lower("search_term").alias("low")).agg(F.min(F.struct("part", "ord", "search_term")).alias("r"))
    w = Window.partitionBy("soc_code").orderBy("r.part", "r.ord", "low")
    return firsts.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < cap).select("soc_code", "r.search_term", "rank")


def top_occupations(employment: DataFrame, cap: int = 40) -> DataFrame:
    """employment(naics3, soc_code, employed) and rank: each industry's largest occupations, ``cap`` of them."""
    w = Window.partitionBy("naics3").orderBy(F.col("employed").desc_nulls_last(), "soc_code")
    return employment.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < cap)


def soc_major(code: Column) -> Column:
    """The major group of an occupation, or ''."""
    bare = F.trim(F.coalesce(code, F.lit("")))
    return F.when(F.length(bare) >= 2, F.concat(F.substring(bare, 1, 2), F.lit("-0000"))).otherwise(F.lit(""))


def search_terms(spark: SparkSession, path: str) -> DataFrame:
    """The term table from CSV with a header, without the excluded major group."""
    from leadloom.schemas import SEARCH_TERMS

    return spark.read.schema(SEARCH_TERMS).option("header", True).csv(path).where(F.col("soc_major") != vocab.EXCLUDED_SOC_MAJOR)


def terms_by_industry(terms: DataFrame) -> DataFrame:
    """(client_industry, place, search_term): core terms in order of rank; only industries that have some."""
    rows = terms.where("tier = 'CORE' and coalesce(client_industry, '') <> ''")
    w = Window.partitionBy("client_industry").orderBy("rank", "soc_code", "search_term")
    return rows.select("client_industry", F.row_number().over(w).alias("place"), "search_term")


def suggest_terms(sector: str, industries: DataFrame, terms: DataFrame, most_rank: int = 5, excluded: list[str] | None = None) -> DataFrame:
    """(place, search_term): searchable terms of the occupations that a sector's industries employ, each once, where it first comes.

    industries(naics3, client_industry, soc_code, rank) in order of code and rank; terms of the first ranks only; the
    excluded major groups always hold the one that is never searched.
    """
    gone = [*(excluded or []), vocab.EXCLUDED_SOC_MAJOR]
    ours = industries.where((F.col("client_industry") == sector) & ~soc_major(F.col("soc_code")).isin(gone)).select("naics3", F.col("rank").alias("place"), "soc_code")
    fit = terms.where(is_searchable(F.col("search_term")) & (F.col("rank") <= most_rank)).select("soc_code", "search_term", "rank")
    # an occupation's first place and a term's first rank in it, so that the join makes no more rows than there are terms of occupations
    ours = ours.groupBy("soc_code").agg(F.min(F.struct("naics3", "place")).alias("first"))
    fit = fit.groupBy("soc_code", "search_term").agg(F.min("rank").alias("rank"))
    firsts = ours.join(fit, "soc_code").groupBy("search_term").agg(F.min(F.struct("first.naics3", "first.place", "soc_code", "rank")).alias("at"))
    return firsts.select(F.row_number().over(Window.orderBy("at", "search_term")).alias("place"), "search_term")  # one sector's terms


def title_votes(identified: DataFrame, industries: DataFrame) -> DataFrame:
    """(company, hint): the industry that most of a company's titles speak for, first seen on ties."""
    votes = identified.join(industries.where("industry is not null"), "title").groupBy("company", "industry").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    return votes.groupBy("company").agg(F.max_by("industry", F.struct(F.col("n").alias("a"), (-F.col("o")).alias("b"))).alias("hint"))


def expand_title(job: str, sector: str, terms: DataFrame, limit: int = 5) -> DataFrame:
    """(title, rank): the job itself, then terms that share a distinctive word, best first.

    A term of the job's own occupation comes before one of the sector, then more shared words, fewer letters, the
    alphabet.  Terms with the same words as an earlier one are left out.
    """
    spark = terms.sparkSession
    tokens = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)))
    asked = spark.createDataFrame([(job,)], "job string").select(tokens(F.col("job")).alias("jt"))
    t = terms.select("search_term", "soc_code", "client_industry", "rank", tokens(F.col("search_term")).alias("tt"))
    rows = t.join(F.broadcast(asked))  # one row
    own = rows.where("tt = jt").select("soc_code").distinct().withColumn("same", F.lit(True))
    rows = rows.join(own, "soc_code", "left")
    shared = F.size(F.array_except(F.array_intersect("tt", "jt"), F.array(*map(F.lit, GENERIC))))
    rows = rows.withColumn("shared", shared).where("tt <> jt and (shared > 0 or same)")
    first = rows.groupBy("tt").agg(F.min_by(F.struct("search_term", "same", "client_industry", "shared"), F.struct("rank", "search_term")).alias("r")).select("r.*")
    order = [F.coalesce("same", F.lit(False)).desc(), F.coalesce(F.col("client_industry") == sector, F.lit(False)).desc(), F.col("shared").desc(), F.length("search_term"), F.lower("search_term")]
    best = first.orderBy(*order).limit(limit - 1).withColumn("rank", F.row_number().over(Window.orderBy(*order)) + 1)
    return spark.createDataFrame([(job, 1)], "title string, rank int").unionByName(best.select(F.col("search_term").alias("title"), "rank"))


def plan(spark: SparkSession, sector: str, job: str, terms: DataFrame, limit: int = 5, max_days: int = 14) -> DataFrame:
    """(title, title_rank, geo_level, geo_ord, geo, hours_old): every title nationwide and in each state; bad arguments are refused."""
    job = " ".join((job or "").split())
    if sector not in vocab.SECTORS:
        raise ValueError(f"unknown sector {sector!r}")
    if not 1 <= len(job) <= 120:
        raise ValueError("a job has 1 to 120 characters")
    states = [c for c in vocab.STATE_CODES if c != "PR"]
    geo = spark.createDataFrame([("COUNTRY", 0, "US")] + [("STATE", i, c) for i, c in enumerate(states, 1)], "geo_level string, geo_ord int, geo string")
    return expand_title(job, sector, terms, limit).withColumnRenamed("rank", "title_rank").crossJoin(F.broadcast(geo)).withColumn("hours_old", F.lit(24 * max_days))  # 5 by 52 rows
