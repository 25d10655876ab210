"""English full text against golden rows, and stems against the published sample vocabulary."""

import re

import pytest

from lumenlog.functions.stemming import ENGLISH_STOP_WORDS, stem
from lumenlog.operators import events as ev, fulltext

#: Words of the published sample vocabulary with their stems.
VOCABULARY = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


@pytest.mark.parametrize("word, expected", list(zip(VOCABULARY[::2], VOCABULARY[1::2], strict=True)))
def test_published_vocabulary(word, expected):
    assert stem(word) == expected


@pytest.mark.parametrize("words", ["study studies studied studying", "policy policies", "hope hopes hoped hoping", "hop hops hopped hopping", "error errors", "connect connected connecting connection connections", "relate related relating relation relational", "fail failed failing fails", "authorization authorize authorized"])
def test_words_of_one_stem(words):
    assert len({stem(w) for w in words.split()}) == 1


@pytest.mark.parametrize("word, expected", [("generate", "generat"), ("general", "general"), ("communism", "communism"), ("arsenal", "arsenal"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("proceed", "proceed"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("by", "by"), ("say", "say"), ("happy", "happi"), ("enjoy", "enjoy"), ("yes", "yes"), ("rational", "ration"), ("agreed", "agre"), ("feed", "feed"), ("bed", "bed"), ("luxuriating", "luxuri"), ("10", "10"), ("été", "été")])
def test_rules(word, expected):
    assert stem(word) == expected


def test_hop_and_hope_differ():
    assert stem("hop") != stem("hope")


ROWS = [
    (1, "The studies of policies failed"), (2, "study a policy"), (3, "Connection to the database was refused"), (4, "database connections refused"), (5, "hoping for hops"), (6, None), (7, ""),
    (8, "end of the line: line 2"), (9, "line the end"), (10, "not-found in /var/log-files"), (11, "file found"), (12, "ÉTUDE naïve"),
]
GOLDEN = [
    ("study", [1, 2]), ("policy study", [1, 2]), ('"study policies"', []), ('"studying a policy"', [1, 2]), ('"studies of policy"', [1, 2]), ("connected", [3, 4]), ('"connect to the database"', [3]), ('"database connection"', [4]), ("refused -connection", []),
    ("database -\"connections to the database\"", [4]), ("hope", [5]), ("hop", [5]), ("hop OR line", [5, 8, 9]), ("line or study policy", [1, 2, 8, 9]), ('"end of the line"', [8]), ('"line the end"', [9]), ('"line an end"', [9]), ('"line end"', []),
    ("the", []), ("", []), ("the OR of", []), ("the line", [8, 9]), ("-line", [1, 2, 3, 4, 5, 6, 7, 10, 11, 12]), ("log-file", [10]), ("files found", [10, 11]), ("étude", [12]), ("unknownword", []), ('"line" 2', [8]), ("-the file -log", [11]), ('"unfinished line', []),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, message string").repartition(3)


@pytest.mark.parametrize("query, ids", GOLDEN)
def test_golden_rows(table, query, ids):
    found = ev.matching(table, ev.Search(text=query, mode="fulltext"))
    expected = ids if query else [r[0] for r in ROWS]  # an empty text is no condition
    assert sorted(r["id"] for r in found.collect()) == expected
    if parsed := fulltext.parsed(query):
        if all(any(not t.absent for t in a) for a in parsed):
            assert sorted(r["id"] for r in fulltext.indexed(fulltext.postings(table), query).collect()) == ids


def plain_match(text, query):
    held = [None if w in ENGLISH_STOP_WORDS else stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    at = lambda term: any(all(i + d < len(held) and held[i + d] == x for x, d in term.lexemes) for i in range(len(held)))
    return any(all(at(t) != t.absent for t in a) for a in fulltext.parsed(query))


@pytest.mark.parametrize("query", ['"the and" OR licensing -token', "under license", '"under the license" OR users -the', "-contact"])
def test_whole_documents_against_a_plain_loop(spark, sf_dir, query):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"] for r in fulltext.matching(docs, query, "text").collect()}
    assert found == {r["doc_id"] for r in docs.collect() if plain_match(r["text"], query)}


def test_the_search_is_one_narrow_step(spark, sf_dir):
    found = fulltext.matching(spark.read.parquet(f"{sf_dir}/documents.parquet"), "under license", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan
