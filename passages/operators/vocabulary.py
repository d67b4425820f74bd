"""Corpus word counts per book and what they say about concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.functions.text import count_words, trim_ws, truncate_words
from passages.operators.ordering import top_rows
from passages.session import broadcast_if_small

TOP_WORDS = 1000
SAMPLE_WORDS = 1000

# English words left out of frequency tables.
STOPWORDS = """
A AN AND ARE AS AT BE BEEN BEING
BUT BY CAN COULD DID DO DOES DOING DONE
FOR FROM HAD HAS HAVE HAVING HE HER HERE
HERS HIM HIS HOW I IF IN INTO IS IT
ITS JUST MAY MIGHT MORE MOST MUST MY NO
NOR NOT OF OFF ON ONCE ONE ONLY OR OTHER
OUR OUT OVER OWN SAME SHALL SHE SHOULD SO
SOME SUCH THAN THAT THE THEIR THEM THEN THERE
THESE THEY THIS THOSE THROUGH TO TOO UNDER UP
US VERY WAS WE WERE WHAT WHEN WHERE WHICH
WHO WHOM WHY WILL WITH WOULD YOU YOUR YOURS
ALSO ABOUT AFTER AGAIN ALL ALMOST ALONG ALREADY
ALTHOUGH ALWAYS AM AMONG ANY ANYONE ANYTHING ANYWHERE
AREAS AROUND AWAY BECAUSE BEFORE BEHIND BELOW
BETWEEN BEYOND BOTH DOWN DURING EACH EITHER ELSE
EVEN EVERY EVERYONE EVERYTHING FEW FURTHER GET GETS
GOT HOWEVER INSIDE INSTEAD ITSELF LESS LIKE
MANY MAYBE MUCH NEED NEEDS NEITHER NEVER NEXT NOW
OFTEN ONTO PERHAPS RATHER REALLY SINCE STILL
THOUGH TILL TOWARD TOWARDS UNLESS UNTIL UPON
USED USING USUALLY VIA WELL WHILE WITHIN WITHOUT
YET
""".split()


def section_samples(sections: DataFrame) -> DataFrame:
    """Sections with text, trimmed, and an excerpt of their first words."""
    trimmed = sections.withColumn("plain_text", trim_ws(F.col("plain_text")))
    return trimmed.where(F.col("plain_text") != "").withColumn(
        "excerpt", truncate_words(F.col("plain_text"), SAMPLE_WORDS)
    )


def word_counts(samples: DataFrame) -> DataFrame:
    """(pdf_id, word, n) over titles and texts."""
    words = F.concat(count_words(F.col("title")), count_words(F.col("plain_text")))
    return (
        samples.select("pdf_id", F.explode(words).alias("word"))
        .groupBy("pdf_id", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unique_words(counts: DataFrame) -> DataFrame:
    return counts.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("unique_tokens"))


def synonym_words(synonyms: DataFrame) -> DataFrame:
    """(feature_id, word) of all words in a feature's phrases."""
    return synonyms.select("feature_id", F.explode(count_words(F.col("synonym"))).alias("word")).distinct()


def frequent_words(counts: DataFrame, synonyms: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """(pdf_id, word, n, forced): a book's commonest words, then catalogue words beyond them.

    Stopwords are left out unless the catalogue uses them. Catalogue words that occur but missed
    the list are added with ``forced`` true.
    """
    if n <= 0:
        n = TOP_WORDS
    protected = synonym_words(synonyms).select("word").distinct()
    stop = counts.sparkSession.createDataFrame([(w,) for w in STOPWORDS], "word string")
    dropped = stop.join(protected, "word", "left_anti")
    flagged = broadcast_if_small(protected.withColumn("_protected", F.lit(True)))
    kept = counts.join(broadcast_if_small(dropped), "word", "left_anti").select("pdf_id", "word", "n")
    listed = top_rows(kept, ["pdf_id"], [F.desc("n"), F.col("word")], n, "_spot").select(
        "pdf_id", "word", "n", F.lit(False).alias("forced")
    )
    named = kept.join(flagged, "word", "left_semi").select("pdf_id", "word", "n")
    missed = named.join(listed, ["pdf_id", "word"], "left_anti").withColumn("forced", F.lit(True))
    return listed.unionByName(missed)


def feature_candidates(counts: DataFrame, synonyms: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pdf_id, feature_id) with any word of a synonym, or of the book's own terms, in the book."""
    catalogue = broadcast_if_small(synonym_words(synonyms))
    by_synonym = counts.join(catalogue, "word").select("pdf_id", "feature_id")
    own = glossary.select("pdf_id", "feature_id", F.explode(count_words(F.col("term"))).alias("word"))
    by_term = own.join(counts, ["pdf_id", "word"], "left_semi").select("pdf_id", "feature_id")
    return by_synonym.unionByName(by_term).distinct()
