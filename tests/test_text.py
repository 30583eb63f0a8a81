import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions.stem import stem

SPARK_TEXT = "Spark is fast. Graphs are fun! Ranking pages with spark works. Nothing here. Use spark now"


def one(spark, column):
    return spark.sql("select 1").select(column).first()[0]


def test_sentences_keep_leading_blanks(spark):
    assert one(spark, X.sentences(F.lit(SPARK_TEXT))) == [
        "Spark is fast.",
        " Graphs are fun!",
        " Ranking pages with spark works.",
        " Nothing here.",
        " Use spark now",
    ]


def slow_sentences(text):
    """The rule, character by character."""
    def kind(c, prefixes):
        return any(unicodedata.category(c).startswith(p) for p in prefixes)

    out, start, i = [], 0, 0
    while i + 3 < len(text):
        a, b, c = text[i : i + 3]
        before = kind(a, ("Ll", "S", "N")) or a.isspace()
        after = kind(c, ("P", "N", "Lu")) or c.isspace() or kind(a, ("S",))
        if before and b in ".!?" and after:
            out.append(text[start : i + 2])
            start = i = i + 2
        else:
            i += 1
    return [s for s in [*out, text[start:]] if s]


def test_sentences_on_random_text(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB1.!? $\n(é+,") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentences(F.col("t"))).collect()
    for text, found in rows:
        assert found == slow_sentences(text), repr(text)


@pytest.mark.parametrize(
    "limit, expected",
    [
        (256, "Spark is fast... Ranking pages with spark works... Use spark now."),
        (40, "Spark is fast... Ranking pag..... Use spark now."),
        (12, "Spark is fas..."),
    ],
)
def test_summary(spark, limit, expected):
    assert one(spark, X.match_summary(F.lit(SPARK_TEXT), "spark", limit)) == expected


def test_summary_without_a_match_or_text(spark):
    assert one(spark, X.match_summary(F.lit("Nothing. At all."), "spark")) == ""
    assert one(spark, X.match_summary(F.lit(None).cast("string"), "spark")) == ""
    assert one(spark, X.match_summary(F.lit(SPARK_TEXT), "  ")) == ""


def test_match_ratio_compares_whole_words(spark):
    ratio = X.match_ratio(F.lit("Data, DATA data x"), ["data"])
    assert one(spark, ratio) == 0.5
    assert one(spark, X.match_ratio(F.lit("  "), ["data"])) == 0


def test_escape_and_highlight(spark):
    text = "a <Spark> & \"b\" 'c' sparkling c++"
    escaped = X.html_escape(F.lit(text))
    assert one(spark, escaped) == "a &lt;Spark&gt; &amp; &#34;b&#34; &#39;c&#39; sparkling c++"
    assert one(spark, X.highlight(F.lit("Spark sparkling c++ \\E"), '"spark c++ \\E"')) == (
        "<em>Spark</em> <em>spark</em>ling <em>c++</em> <em>\\E</em>"
    )


def test_phrase_detection():
    assert X.is_phrase('"a b"') and X.is_phrase('"') and not X.is_phrase('"a') and not X.is_phrase("")
    assert X.query_terms('"a  b"') == ["a", "b"]


def test_shown_title(spark):
    rows = spark.createDataFrame([("t", "u"), ("", "u"), (None, "u")], "title string, url string")
    assert [r[0] for r in rows.select(X.shown_title(F.col("title"), F.col("url"))).collect()] == ["t", "u", "u"]


# Pairs from the published description of the algorithm and its sample vocabulary.
STEMS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist
consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consolingly consol
knack knack knackeries knackeri knacks knack knave knave knaves knave knavish knavish kneaded knead
kneeled kneel knees knee knightly knight knitted knit knots knot
generate generat generously generous communication communic hoping hope hopping hop flies fli dies die ties tie
cries cri gas gas this this kiwis kiwi gaps gap skies sky news news sky sky agreed agre luxuriating luxuri
relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal
happiness happi possibly possibl analogy analog say say by by enjoy enjoy youth youth boyish boyish
electricity electr hopeful hope replacement replac adoption adopt controll control rate rate cease ceas
inning inning proceeded proceed succeeds succeed formative format quickly quick beautifully beauti
example exampl abc123s abc123s
""".split()


def test_stem(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame(pairs, "word string, want string").withColumn("got", stem(F.col("word")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []
