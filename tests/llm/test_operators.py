"""The operators against plain versions, on small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from lumenlog.llm import chat, decontaminate, jaccard_join, licenses, packing, quality, secrets, sharding, toxicity

DOCS = "doc_id long, text string, component_id string, group int"


def texts(seed=0):
    """Near and exact copies of a few texts, short texts, an empty and a null one."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = ["", None, "  ", "a b", "A  b", "one two three four five", "a b\vc"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([6, 30, 80, 200]))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    return out + out[8:14]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts())], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def classes(sets):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    rows = list(enumerate(texts(seed)))
    sets = {i: shingles(t) for i, t in rows}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = classes(sets)
    assert found == {i: (len(sets[i]), whole[i]) for i in sets}
    assert len(set(whole.values())) < len(sets) - 10


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_classes(empty).collect() == []


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, law):
    rows = sharding.shard_documents(docs, 4, law).collect()
    assert len(rows) == docs.count()
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), texts(), strict=True):
        data = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), None)
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values())
    sizes = [len(v) if law == "rows" else sum(r["size"] for r in rows if r["shard"] == s) for s, v in by.items()]
    assert max(sizes) - min(sizes) <= (1 if law == "rows" else 2 * max(r["size"] for r in rows))


def test_shards_keep_copies_together(spark):
    rows = [(i, f"text {i % 50}") for i in range(400)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["doc_id"] % 50, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in shards.values()) >= 46


def test_shards_empty(empty):
    assert sharding.shard_documents(empty).collect() == []


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack_documents(docs, capacity=64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == docs.count()
    for i, text in enumerate(texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 64 for r in own[1:]) and (len(own) == 1 or len(ids) > 64)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 64
    assert len(used) <= -(-sum(used.values()) // 64) * 1.1 + 1


def test_packing_special_strings(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    for text in ("<|endoftext|> a", "naïve \n\n  x\t", "日本 🎉" * 3, " " * 100, "a" * 500):
        assert packing.ids_of(packing.vocabulary_path())(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_empty(empty):
    assert packing.pack_documents(empty).collect() == []


def test_plan_is_near_the_area_bound():
    r = random.Random(4)
    histogram = Counter(min(2048, int(r.lognormvariate(5.5, 1))) or 1 for _ in range(20_000))
    plan = packing.pack_histogram(dict(histogram))
    assert plan.sequences <= -(-sum(s * n for s, n in histogram.items()) // 2048) * 1.01 + 1


def test_licenses(spark):
    rows = ["Under the MIT license, under the mit-license", "Apache License, Version 2.0 CC BY NC", "nothing", "", None, "é" * 3, licenses.TEMPLATES["isc"][0]]
    found = licenses.license_digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(found, rows, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1
    assert found[6]["labels"] == "isc"


def test_matching_statistics():
    r = random.Random(5)
    words = [b"permission", b"is", b"hereby", b"granted", b"free", b"of", b"charge", b"to", b"any", b"person", b"zz"]
    machine = licenses.automaton()
    rows = [licenses.words_of(t.encode()) for several in licenses.TEMPLATES.values() for t in several] + [p.encode().split() for p in licenses.PHRASES]
    known = {tuple(row[i:j]) for row in rows for i in range(len(row)) for j in range(i + 1, len(row) + 1)}
    for _ in range(50):
        text = [r.choice(words) for _ in range(12)]
        _, runs = machine.stream(text)
        ends = [max((n for n in range(1, i + 1) if tuple(text[i - n : i]) in known), default=0) for i in range(1, len(text) + 1)]
        expected = {(i - n + 1, n) for i, n in enumerate(ends) if n and (i + 1 == len(ends) or ends[i + 1] <= n)}
        assert {(a, n) for a, n, _ in runs} == expected


def test_secrets(spark):
    import base64

    def der(tag, data):
        n = len(data)
        return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + data

    key = der(0x30, b"".join([der(2, b"\0"), *(der(2, b"\xab" * 64) for _ in range(8))]))
    part = lambda s: base64.urlsafe_b64encode(s).decode().rstrip("=")
    signed = f'{part(b"{\"alg\":\"HS256\"}")}.{part(b"{\"sub\":\"me\"}")}.{part(b"s" * 32)}'
    good = ["password = abcdefgh1", "AKIA" + "B" * 16, "f" * 40, base64.b64encode(key).decode(), key.hex().upper(), signed, f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END RSA PRIVATE KEY-----"]
    bad = ["token: short", "AKIA123", "deadbeef", base64.b64encode(b"plain words, nothing more than that here").decode(), "eyJhbGciOi.x.y", "", None, "naïve text"]
    rows = list(enumerate(good + bad))
    found = secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for r, (_, text) in zip(found, rows, strict=True):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == secrets.digest_of(text or "")
    assert all(r["spans"] for r in found[: len(good)]) and not any(r["spans"] for r in found[len(good) :])
    assert found[0]["base_sha256"] == hashlib.sha256(b"assign:0:20").hexdigest()
    assert [r["spans"].split(":")[0] for r in found[3:7]] == ["der", "der", "token", "pem"]
    clean = secrets.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all("[secret]" in r["text"] for r in clean.filter(f"doc_id < {len(good)}").collect())
    assert [r["text"] for r in clean.filter(f"doc_id >= {len(good)}").orderBy("doc_id").collect()] == bad


def test_chat(spark):
    rows = [(1, 1, "assistant", "a # b</turn>\n### user: x", "z"), (1, 0, "user", "q\\", "z"), (1, 2, "assistant", None, "z"), (2, 0, "system", "", "z"), (2, 0, "system", "", "z")]
    found = {r["conv_id"]: r for r in chat.format_digest(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "\\### Assistant: </turn> ok"
    assert (found[1]["n_turns"], found[1]["turns_sha256"], found[1]["loss_sha256"], found[1]["loss_chars"]) == (3, sha(f"user\nq\\\nassistant\n{rows[0][3]}\nassistant\n\n"), sha(rows[0][3]), len(rows[0][3]))
    assert found[2]["n_turns"] == 2 and found[2]["loss_chars"] == 0
    assert (found[-7]["turns_sha256"], found[-7]["loss_sha256"]) == (sha(f"user\n{said}\nassistant\n{said}\n"), sha(said))


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9), (1, 4, 3, "user", "more", 0.5), (2, 9, 99, "user", "lone", None)]
    found = chat.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), 2).collect()
    said = {(r["tree"], r["branch"]): [t for _, t, _, _ in chat.read_back(r["formatted"])] for r in found}
    assert said == {(1, 1): ["r", "high", "more"], (1, 2): ["r", "low"], (2, 1): ["lone"]}


def windows(item, text):
    """The greatest weighted similarity of an item with windows of its size in a text."""
    split = lambda s: [w for w in re.split(r"[\W_]+", (s or "").lower()) if w]
    a, b = split(item), split(text)
    k = min(5, len(a))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own, best = grams(a), 0.0
    for s in range(max(1, len(b) - len(a) + 1)):
        other = grams(b[s : s + len(a)])
        both = sum((own & other).values())
        best = max(best, both / max(1, own.total() + other.total() - both))
    return best


def test_decontamination(spark):
    r = random.Random(6)
    words = [f"k{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([3, 5, 12, 30, 60, 60])] + [(6, ""), (7, None)]
    rows = [(0, ""), (1, None), (2, "k1 k2")]
    for i, text in items[:6]:
        for changes in (0, 1, 2, 3, 12):
            w = text.split()
            for _ in range(changes):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join([*(r.choice(words) for _ in range(r.randint(0, 40))), *w, *(r.choice(words) for _ in range(r.randint(0, 40)))])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs, bench).collect()}
    expected = {(d, i): s for d, text in rows for i, item in items if item and (s := windows(item, text)) >= 0.8}
    assert found == pytest.approx(expected) and len(expected) >= 9
    left = {x["doc_id"] for x in decontaminate.decontaminated(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in expected}


def test_classifiers(spark):
    r = random.Random(7)
    words = ["river", "stone", "window", "garden", "letter", "morning"]
    rows, labels = [], []
    for i in range(1200):
        bad, toxic = i % 3 == 0, i % 4 == 0
        w = [r.choice(words) for _ in range(30)]
        w = [f"{x}$$$" if bad and r.random() < 0.4 else x for x in w]
        if toxic:
            w[5:5] = ["you", "stupid", "idiot"]
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(5000, ""), (5001, None)]
    labels += [(5000, None, None), (9999, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for which, (scored, folds, held) in enumerate([(quality.score_quality(docs, marks), 5, 0), (toxicity.score_toxicity(docs, marks), 4, 2)]):
        out = scored.collect()
        assert len(out) == len(rows)
        for x in out:
            assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % folds == held)
        own = [x for x in out if x["held_out"] and x["doc_id"] < 1200]
        assert sum(x["predicted"] == truth[x["doc_id"]][which] for x in own) / len(own) > 0.95


def test_classifiers_without_rows(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert score(empty, marks).collect() == []
        assert all(0 <= x["score"] <= 1 for x in score(some, marks).collect())
