"""Rules by the fixed lexicons, row by row."""

from pyspark.sql import functions as F

from proofline.functions import lexicons as L
from proofline.functions import text as T
from proofline.operators import texts as O


def told(spark, rule, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    return [r.out for r in df.select("k", rule(F.col("text")).alias("out")).orderBy("k").collect()]


def test_events(spark):
    assert told(spark, T.classify_event, "Ternyata he must fight.", "An ENEMY suddenly.", "Next chapter soon", "He slept.", "The twister") == ["twist", "conflict", "cliffhanger", "event", "twist"]


def test_narration_tags(spark):
    rows = ["He hit the Dragon", "She says: réveal", "the battle is won", "a sword, an explosion; they think", "swords", None, "Finally2 fire"]
    assert told(spark, T.narration_tags, *rows) == [["action", "attack", "monster"], ["dialogue"], ["action", "victory"], ["explosion", "thinking", "weapon"], [], [], ["explosion", "reveal"]]


def test_narration_language(spark):
    assert told(spark, T.narration_language, "The person enters", "yang dan the", "", "the dan", "THE AND yang", None) == ["en", "id", "id", "id", "en", "id"]


def test_reveals(spark):
    rule = lambda t: T.without_reveals(t, F.lit("minimal"))
    rows = ["It rains. It turns out he won. He slept", "Ternyata dia. Akhirnya Budi menang!", "turns outward\nRupanya. x", "", "akhirnya él kalah."]
    assert told(spark, rule, *rows) == ["It rains. He slept", L.TEASE, "x", L.TEASE, L.TEASE]
    assert told(spark, lambda t: T.without_reveals(t, F.lit("full")), rows[1]) == [rows[1]]


def test_calls_and_hype(spark):
    rows = [(1, "p", "Please  LIKE and Subscribe"), (2, "p", "an epic battle"), (3, "p", "Epic battle, insane power"), (4, "q", "subscribers drop a like"), (5, "q", "leave comment"), (6, None, "watch until the end"), (7, "q", None)]
    found = {r.k: (r.calls, r.markers, r.hype, r.project_hype, r.project_markers) for r in O.viewer_calls(spark.createDataFrame(rows, "k int, p string, text string"), "k", "p").collect()}
    assert found == {1: (True, 1, 0, 2, 1), 2: (False, 0, 1, 2, 1), 3: (False, 0, 2, 2, 1), 4: (True, 1, 0, 0, 1), 5: (True, 0, 0, 0, 1), 6: (False, 1, 0, 0, 1), 7: (False, 0, 0, 0, 1)}
