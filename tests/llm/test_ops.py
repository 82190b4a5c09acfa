"""The ten operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronofold.llm import common, exact_dedup, lines, media, mixing, near_dedup, packing, quality, secrets, sharding, substrings
from chronofold.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
EXTRA = ("row", "digest", "id", "label", "start", "key", "block", "size", "score", "copies", "weight", "target", "line", "x", "u", "v", "queue", "gone")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """rows: (doc_id, text, source); further columns have names that operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *["?"] * len(EXTRA)) for d, t, s in rows], schema)


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, "One two three four five six", "a"), (2, "one TWO three four five six", "b"), (3, None, None), (4, "", "a"), (5, " \n\t", None), (6, long, "b"), (7, "ÉCOLE école", "ü"), (7, "ÉCOLE école", "ü"), (None, "no id at all", "a"), (8, "tie", "b"), (9, "tie", "b"), (-3, "Tie", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def lower(text):
    return text.encode().lower()


# 1

def mix_rows():
    rnd = random.Random(1)
    return [(i, "w " * rnd.randint(0, 40), rnd.choice(["a", "b", "c", None])) for i in range(300)]


def mix_targets(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        v = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * v > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * v for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    return sizes, target


def test_mix_meets_targets(spark):
    rows = mix_rows()
    frame = table(spark, rows)
    got = mixing.mix(frame, mixing.n_words(mixing.F.col("text"))).collect()
    sizes, target = mix_targets(rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    # One order cut at the budget: all words of it are taken, and a source is off by the document at its cut.
    assert sum(taken.values()) == int(1.5 * sum(sizes.values())) and all(abs(taken[s] - target[s]) <= mixing.PACKET for s in sizes)
    again = mixing.mix(frame.repartition(5), mixing.n_words(mixing.F.col("text"))).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_the_stream_is_sorted_by_finish_time_and_cut_at_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PACKET", 7)
    sizes, target = mix_targets(mix_rows())
    held, _, packets = mixing.stream(table(spark, mix_rows()), mixing.n_words(mixing.F.col("text")))
    rows = sorted(packets.collect(), key=lambda r: r["before"])
    weight, budget, at = {"+a": 3, "+b": 1, "+c": 2, "-": 3}, int(1.5 * sum(sizes.values())), 0
    own, sent, taken = Counter(), Counter(), Counter()
    for x, y in zip(rows, rows[1:]):
        assert (x["finish"], x["source_key"]) <= (y["finish"], y["source_key"])
    for r in rows:
        own[r["source_key"]] += r["words"]
        sent[r["row"], r["pass"]] += r["words"]
        taken[r["source_key"]] += r["taken"]
        assert r["before"] == at and r["finish"] == own[r["source_key"]] / weight[r["source_key"]] and 0 < r["words"] <= 7
        assert r["taken"] == max(0, min(r["words"], budget - at))
        at += r["words"]
    assert sent == Counter({(r["row"], k): r["size"] for r in held.collect() for k in (0, 1) if r["size"]})
    assert all(abs(taken["-" if s is None else f"+{s}"] - target[s]) <= 7 for s in sizes)


def test_mix_of_whole_documents(spark, monkeypatch):
    rows = mix_rows()
    sizes, target = mix_targets(rows)
    for most in (10_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        got = mixing.mix_whole(table(spark, rows)).collect()
        copies = Counter(r["doc_id"] for r in got)
        taken = Counter()
        for r in got:
            taken[r["source"]] += len(r["text"].split())
            assert r["weight"] == "?" and r["text"].strip()
        assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    assert mixing.mix_whole(table(spark, [])).count() == 0


def test_mix_of_odd_rows(spark):
    size = mixing.n_words(mixing.F.col("text"))
    got = mixing.mix(table(spark, odd_rows()), size).collect()
    sizes, target = mix_targets(odd_rows())
    assert len(got) == len(odd_rows()) and sum(r["taken"] for r in got) == int(1.5 * sum(sizes.values()))
    assert {r["doc_id"]: r["taken"] for r in got}[3] == 0
    assert mixing.mix(table(spark, []), size).count() == 0
    assert {r["taken"] for r in mixing.mix(table(spark, [(1, "", "a"), (2, None, None)]), size).collect()} == {0}
    assert sum(r["taken"] for r in mixing.mix(table(spark, [(None, "a b c", "a")] * 50), size).collect()) == 225


# 2

def test_payloads_round_trip(spark, texts):
    for text in [*texts.values(), "", "x" * 64, "é" * 200]:
        payload = media.payload_of(text.encode())
        assert len(payload) % 64 == 0 and len(payload) > 0 and media.decode(media.encode(payload)) == payload
    with pytest.raises(ValueError):
        media.decode(media.encode(bytes(64))[:-20] + bytes(20))
    got = media.op2_media(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = media.payload_of(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode(payload)).hexdigest() and r["caption"] == f"document {r['doc_id']}" and r["pos"] == 1


def test_media_of_odd_rows(spark):
    rows = [*odd_rows(), (50, "<nav>a & b</nav> </pre> &amp; <img src=x>", "a")]
    got = media.media_table(table(spark, rows)).collect()
    told = Counter()
    for d, t, _ in rows:
        payload = media.payload_of((t or "").encode())
        x = np.frombuffer(payload, np.uint8).astype(float)
        told[(d, len((t or "").encode()), hashlib.sha256(payload).hexdigest(), f"{len(x) // 64}:{x.mean():.4f}")] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], ":".join(r["feature"].split(":")[:2])) for r in got) == told
    for r in got:
        assert [x["pos"] for x in r["items"]] == list(range(len(r["items"]))) and r["items"][r["pos"]]["digest"] == r["digest"] == r["payload_sha256"]
    assert media.media_table(table(spark, [])).count() == 0


def test_pages_of_the_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in media.sequences(pages).collect():
        told = " ".join(x["text"] for x in r["items"] if x["kind"] == "text")
        title = re.search(r"<h1>(.*?)</h1>", html[r["page_id"]], re.S)
        assert r["url"] and [x["pos"] for x in r["items"]] == list(range(len(r["items"]))) and "track(0)" not in told
        assert title is None or media.html.unescape(title[1]).strip()[:20] in told


def test_unclosed_elements_keep_their_text():
    assert [x["text"] for x in media.parse("<p>a</p><nav>b <p>c</p>")] == ["a", "b c"]
    assert [x["text"] for x in media.parse("<nav>x</nav><p>a</p><footer>b")] == ["a", "b"]
    assert [x["text"] for x in media.parse("<p>a<p>b <b>c")] == ["a", "b c"]


def test_pages_keep_order_and_captions(spark):
    page = "<h1>A &amp; b</h1><p>one<br>two</p><script>no</script><figure><img src='x.png' alt='alt'><figcaption>the <b>caption</b></figcaption></figure><p>three</p><img src='sha256:ff'>"
    items = media.parse(page)
    assert [(x["kind"], x["text"], x["caption"]) for x in items] == [("text", "A & b", None), ("text", "one", None), ("text", "two", None), ("media", None, "the caption"), ("text", "three", None), ("media", None, None)]
    assert [x["pos"] for x in items] == list(range(6)) and items[5]["digest"] == "ff"
    assert media.parse(None) == media.parse("") == []
    frame = spark.createDataFrame([(1, page, "?"), (2, None, "?")], "page_id long, html string, digest string")
    got = {r["page_id"]: r["items"] for r in media.sequences(frame).collect()}
    assert len(got[1]) == 6 and got[2] == []
    items = spark.createDataFrame([(1, "ff"), (2, "no")], "page_id long, digest string")
    payload = bytes(range(64))
    store = spark.createDataFrame([(hashlib.sha256(payload).hexdigest(), bytearray(media.encode(payload)))] * 3, "digest string, media binary")
    assert media.describe(store).count() == 1
    assert {r["page_id"]: r["payload_bytes"] for r in media.resolve(items, media.describe(store)).collect()} == {1: None, 2: None}


# 3

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def secret_rows():
    key, access = "abCD" * 10, "AKIA" + "Q1" * 8
    return [
        (21, f"é {access} then {key}", "a"),
        (22, f"{key} alone", "a"),
        (23, f"{access}{' ' * 400}{key}", "a"),
        (24, f"see https://host.example/x and {key}", "a"),
        (25, "password=x.token = abcdefghijklmnop secret=token=abcdefghijkl API_KEY : 'AAAAAAAAAAAA' token=short", "a"),
        (26, "0123456789abcdef" * 3 + " \n" + "deadbeef", None),
        (27, "AKIA" * 4 + "X", None),
        (28, "paſsword=abcdefghijklmnop toKen=abcdefghijklmnop", None),
        (29, ("x" * 50 + " token: " + "a1" * 10 + "\n") * 300, "b"),
        *odd_rows(),
    ]


def test_secrets_match_brute_force(spark):
    rows = secret_rows()
    got = secrets.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = Counter((d, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == expected
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[21].split(",")[1].startswith("key:") and spans[24].startswith("endpoint:") and ",key:" in spans[24]
    assert spans[22] == "" and "key" not in spans[23]
    assert secrets.scan(table(spark, [])).count() == 0


def test_secrets_in_the_small_table(spark, texts):
    for r in secrets.op3_secrets(spark, SMALL).collect():
        assert r["base_sha256"] == hashlib.sha256(base_spans(texts[r["doc_id"]]).encode()).hexdigest()


# 4

def test_exact_dedup(spark):
    rows = [*odd_rows(), *[(100 + i, "COPY" if i % 2 else "copy", "a") for i in range(50)]]
    for counters in (1, 512):
        got = exact_dedup.exact_dedup(table(spark, rows), counters=counters).collect()
        groups = defaultdict(list)
        for d, t, _ in rows:
            groups[hashlib.sha256(lower(t or "")).hexdigest()].append(d)
        assert len(got) == len(rows)
        kept = Counter()
        for r in got:
            own = groups[r["text_sha256"]]
            assert r["group_size"] == len(own) and r["keep_id"] == max((d for d in own if d is not None), default=None)
            kept[r["text_sha256"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    import pyarrow as pa

    values = [b"hot"] * 40 + [str(i).encode() for i in range(60)]
    random.Random(2).shuffle(values)
    out = next(exact_dedup.misra_gries([pa.RecordBatch.from_pydict({"digest": values})], 3))
    assert b"hot" in out.column(0).to_pylist() and out.num_rows <= 3


# 5

def within_one(a, b):
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return abs(len(a) - len(b)) == 1 and (a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :])


def without_repeats(rows):
    earlier, out = [], {}
    for d, t in sorted(dict.fromkeys((d, t) for d, t, _ in rows if t is not None), key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in t.split("\n"):
            again = False
            if len(line) >= lines.MIN_CHARS:
                again = any(within_one(line, x) for x in earlier)
                earlier.append(line)
            if not again:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def line_rows():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "été", "zeta", "eta", "日本"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 9))) for _ in range(25)]

    def edit(x):
        i, c = rnd.randrange(len(x)), rnd.choice("abcé𝔘")
        return rnd.choice([x, x[:i] + x[i + 1 :], x[:i] + c + x[i:], x[:i] + c + x[i + 1 :]])

    rows = [(d, "\n".join(edit(edit(rnd.choice(base))) if rnd.random() < 0.4 else edit(rnd.choice(base)) for _ in range(rnd.randint(0, 6))), "a") for d in range(60)]
    return [*rows, (None, "no id\n" + base[0], "b"), (500, None, None), (501, "", "b"), rows[7], (502, "a" * 40 + "\n" + "a" * 41 + "\n" + "a" * 43, "b")]


def test_line_dedup(spark):
    rows = line_rows()
    expected = without_repeats(rows)
    got = lines.drop_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == (None if r["doc_id"] == 500 else expected[r["doc_id"]]) and r["key"] == "?"
    assert lines.drop_lines(table(spark, [])).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(lines, "SENT", 3)
    monkeypatch.setattr(lines, "HOT", 1.0)
    expected = without_repeats(line_rows())
    assert all(r["text"] == expected[r["doc_id"]] for r in lines.drop_lines(table(spark, line_rows())).collect() if r["doc_id"] != 500)


def thue_morse(n=4096):
    """Two texts that any polynomial hash modulo a power of two takes for equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_one_edit_is_verified():
    rnd = random.Random(8)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7)))
        b = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7)))
        assert lines.within_one(a, b) == within_one(a, b)


def test_lines_that_fool_weak_hashes_stay(spark):
    a, b = thue_morse()
    rows = [(1, a, "a"), (2, b, "a"), (3, "x" * 70_000 + "y" * 70_000, "a"), (4, "x" * 70_000 + "zy" + "y" * 69_999, "a"), (5, "x" * 69_999 + "y" * 70_000, "a")]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_lines(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}, got


def test_a_very_common_line(spark):
    rows = [(i, f"the same line over and over again\nown line number {'abcdefghij'[i % 10] * (3 + i)}", "a") for i in range(400)]
    got = lines.drop_lines(table(spark, rows).repartition(9)).collect()
    assert all(r["text"].startswith("the same") == (r["doc_id"] == 0) for r in got)
    with pytest.raises(ValueError):
        lines.drop_lines(table(spark, rows), dropped="gone")


# 6

def test_bytes_that_fool_weak_hashes_stay(spark):
    a, b = thue_morse(1024)
    rows = [(1, a, "a"), (2, b, "a")]
    assert Counter(map(tuple, substrings.remove_repeats(table(spark, rows)).drop("kept").collect())) == removed(rows)


def removed(rows):
    seen, out = Counter(), []
    raw = [(d, (t or "").encode()) for d, t, _ in rows]
    for _, x in raw:
        seen.update(x[p : p + 200] for p in range(len(x) - 199))
    for d, x in raw:
        gone = np.zeros(len(x) + 1, int)
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p : p + 200] = 1
        g = gone[: len(x)] > 0
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((d, len(x), int(g.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~g].tobytes()).hexdigest()))
    return Counter(out)


def test_repeated_substrings(spark):
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    shared, other = text(260), text(420)
    rows = [(i, text(rnd.randint(0, 300)) + rnd.choice([shared, shared[: rnd.randint(190, 260)], other[rnd.randint(0, 210) :], ""]) + text(rnd.randint(0, 300)), "a") for i in range(60)]
    rows += [(100, "ab" * 300, "a"), (101, "x" * 199, "a"), (102, "x" * 199, "a"), (103, "y" * 200, "a"), (104, "z" * 201, "a"), (105, other * 3, "a"), *odd_rows()]
    got = substrings.remove_repeats(table(spark, rows)).drop("kept")
    assert Counter(map(tuple, got.collect())) == removed(rows)
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_repeated_substrings_in_the_small_table(spark, texts):
    assert Counter(map(tuple, substrings.op6_suffix_dedup(spark, SMALL).collect())) == removed([(d, t, None) for d, t in texts.items()])


# 7

def test_shards(spark):
    rows = table(spark, [*odd_rows(), *[(None, "same", "a")] * 500]).select("doc_id", "text")
    got = sharding.shuffle_shards(rows, shards=24).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["__shard"]].append(r["__slot"])
    assert len(got) == 512 and len(slots) == 24 and {len(x) for x in slots.values()} <= {21, 22}
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shuffle_shards(table(spark, []), shards=24).count() == 0
    assert sharding.shuffle_shards(rows.limit(1), shards=24).count() == 1


def test_communication_matrix():
    rng = random.Random(1)
    matrix = sharding.communication_matrix([7, 0, 30, 13], 4, rng)
    assert [sum(r) for r in matrix] == [7, 0, 30, 13] and sorted(map(sum, zip(*matrix))) == [12, 12, 13, 13]
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.1) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    assert 4.9e11 < sharding.hypergeometric(rng, 10**14, 10**14, 10**12) < 5.1e11


def test_shards_of_the_small_table(spark, texts):
    got = sharding.op7_sharding(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and {len(x) for x in slots.values()} == {8, 9}
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_odds_are_exact_at_any_size():
    from fractions import Fraction
    from math import comb

    for good, bad, draws in ((30, 70, 20), (5, 900, 40), (1000, 9000, 500), (20_000, 460_000, 20_000)):
        share, rest = draws / (good + bad), (good + bad - draws) / (good + bad)
        for k in range(0, min(good, draws, 60) + 1, 7):
            p = float(Fraction(comb(good, k) * comb(bad, draws - k), comb(good + bad, draws)))
            got = math.exp(sharding._log_binomial(k, good, share, rest) + sharding._log_binomial(draws - k, bad, share, rest) - sharding._log_binomial(draws, good + bad, share, rest))
            assert got == pytest.approx(p, rel=1e-9)


# 8

def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = quality.op8_quality(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_quality_of_odd_rows(spark):
    frame = table(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(frame, none).collect()} == {1.0}
    bad = spark.createDataFrame([(1, 0), (2, 0), (6, 0), (1, 0), (None, 0), (4, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(frame, bad).collect()} == {0.0}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(frame.select("doc_id", "text"))
    got = quality.classify(docs, labels).collect()
    assert len(got) == 200 + len(odd_rows()) and all(np.isfinite(r["score"]) for r in got)
    assert quality.classify(table(spark, []), labels).count() == 0
    assert quality.keep_good(table(spark, []), labels).count() == 0


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, quality.D)) @ rng.normal(size=(quality.D, quality.D))
    y = (rng.random(600) < 0.4).astype(int)
    x[y == 1] *= 1.5
    x[y == 1] += 0.7
    sums = np.stack([np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()]) for own in (x[y == 0], x[y == 1])])
    model = quality.Discriminant(sums)
    cov = [np.cov(x[y == c], rowvar=False, bias=True) for c in (0, 1)]
    pooled = sum(c * n for c, n in zip(cov, np.bincount(y))) / len(y)
    scale = np.sqrt(np.diag(pooled))
    density = []
    for c in (0, 1):
        s = (0.9 * cov[c] + 0.1 * pooled) / np.outer(scale, scale)
        s = 0.98 * s + 0.02 * np.trace(s) / quality.D * np.eye(quality.D)
        z = (x - x[y == c].mean(0)) / scale
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) + np.linalg.slogdet(s)[1]))
    assert np.allclose(np.sinh(model.difference(x)), density[1] - density[0], rtol=1e-6, atol=1e-6)


# 9

def check_pieces(rows, got, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    expected = Counter()
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected[(d, ids.tobytes())] += 1
    by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in by_place:
        assert r["sequence_id"] * window + r["offset"] == at
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        at += r["length"]
    assert at == sum(len(x) // 4 * n for (_, x), n in expected.items())
    pieces = defaultdict(list)
    for r in got:
        pieces[(r["doc_id"], r["start"], r["doc_tokens"])].append(np.array(r["ids"], "<u4"))
    for (d, raw), n in expected.items():
        ids = np.frombuffer(raw, "<u4")
        total, start = len(ids), 0
        while start < total:
            own = next(p for p in pieces[(d, start, total)] if (p == ids[start : start + len(p)]).all())
            start += len(own)


def test_packing(spark, docs):
    rows = [*odd_rows(), (200, "don't <|endoftext|> STOP here İx 12,5% café é 日本語", "c"), *[(r["doc_id"] + 1000, r["text"], r["source"]) for r in docs.limit(40).collect()]]
    for window, granule in ((64, 8), (4096, 256)):
        check_pieces(rows, packing.pack_documents(table(spark, rows), window=window, granule=granule, with_ids=True).collect(), window)
    check_pieces(rows, packing.pack_documents(table(spark, rows), window=64, granule=8, max_queues=2, with_ids=True).collect(), 64)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_windows_hold_target_proportions():
    totals = [90_000, 30_000, 9_000]
    r = packing.Rounds(totals, 4096, 256)
    share = Counter()
    for q, total in enumerate(totals):
        for start, length, at in r.pieces(q, 0, total):
            share[(at // 4096, q)] += length
    for w in range(2, 28):
        for q, total in enumerate(totals):
            assert abs(share[(w, q)] - 4096 * total / sum(totals)) <= 2 * 256


def served(totals, window, granule, mixture=None):
    """The stream by really going round: (queue, place in the queue) of each token."""
    r = packing.Rounds(totals, window, granule, mixture)
    gone, stream, turn = [0] * len(totals), [], 0
    while any(g < t for g, t in zip(gone, totals)):
        for q, t in enumerate(totals):
            credit = (turn + 1) * int(r.quantum[q]) >> packing.SHIFT
            upto = t if credit >= t else min(t, (credit + int(r.phase[q])) // granule * granule)
            stream += [(q, x) for x in range(gone[q], upto)]
            gone[q] = max(gone[q], upto)
        turn += 1
    return stream


@pytest.mark.parametrize("totals, mixture", [([700, 30, 1, 0, 400], None), ([700, 300, 200], [1.0, 5.0, 1.0]), ([5], None), ([1, 1, 1, 900], None)])
def test_rounds_against_going_round(totals, mixture):
    stream = {x: i for i, x in enumerate(served(totals, 64, 16, mixture))}
    r, rnd = packing.Rounds(totals, 64, 16, mixture), random.Random(9)
    for q, total in enumerate(totals):
        before = 0
        while before < total:
            n = min(total - before, rnd.randint(1, 90))
            at = [(start + x, place + x) for start, length, place in r.pieces(q, before, n, 64) for x in range(length)]
            assert at == [(x, stream[q, before + x]) for x in range(n)]
            before += n


def test_a_source_with_a_tiny_share_costs_no_more():
    import tracemalloc

    r = packing.Rounds([10**13, 1000, 10**5], 4096, 256)
    tracemalloc.start()
    assert sum(x[1] for x in r.pieces(1, 0, 1000)) == 1000 and sum(x[1] for x in r.pieces(2, 0, 10**5)) == 10**5
    assert sum(x[1] for x in r.pieces(0, 10**13 - 1000, 1000)) == 1000
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_windows_hold_a_mixture_across_partitions(spark):
    rows = [(i, " ".join(f"w{i} x{j}" for j in range(30)), "abc"[i % 3]) for i in range(240)]
    got = packing.pack_documents(table(spark, rows).repartition(7), window=512, granule=32, mixture={"a": 4, "b": 2, "c": 1}).collect()
    source = {d: s for d, _, s in rows}
    share, total = Counter(), sum(r["length"] for r in got)
    for r in got:
        share[r["sequence_id"], source[r["doc_id"]]] += r["length"]
    for w in range(1, int(total / 3 / (512 * 4 / 7)) - 1):
        for s, part in (("a", 4), ("b", 2), ("c", 1)):
            assert abs(share[w, s] - 512 * part / 7) <= 2 * 32


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Hello  World, don't\n\tSTOP é"
    e = packing.encoder(path)
    assert not e.fast and np.frombuffer(e.encode(text.encode()), e.dtype).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.encoder(packing.default_vocabulary()).fast


# 10

def components(rows, percent=85):
    sets = {}
    for d, t, _ in rows:
        w = WORDS.findall((t or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sets, find


def test_near_dedup(spark):
    rnd = random.Random(10)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 99))
    base = [[word() for _ in range(rnd.randint(5, 120))] for _ in range(12)]

    def change(w):
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        return " ".join(w[rnd.randint(0, 2) :])

    rows = [(i, change(rnd.choice(base)), "a") for i in range(250)] + [(300, "one two", "a"), (301, "ONE  two", "a"), (302, "one two three", "a"), (303, None, None), (304, "", None), (305, " \t", None)]
    sets, find = components(rows)
    got = near_dedup.near_duplicates(table(spark, [*rows, (None, "one two", "a"), rows[3]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def hub_family(copies, words=150, far=40):
    """A base, copies that link to it alone, and texts somewhat nearer to it than any link."""
    rnd = random.Random(copies)
    base = [f"b{i}" for i in range(words)]

    def change(at, name):
        w = list(base)
        for x in at:
            w[x] = f"{name}x{x}"
        return " ".join(w)

    rows = [(1000, " ".join(base), "a")] + [(i, change([rnd.randrange(4, 72), rnd.randrange(78, words - 4)], f"c{i}"), "a") for i in range(copies)]
    # Each of the last ones links to one copy alone, and not to the base.
    outer = [(2000 + i, " ".join([*rows[1 + i][1].split()[:-1], f"o{i}", f"p{i}", f"q{i}", f"r{i}", f"s{i}", f"t{i}"]), "a") for i in range(far)]
    return rows + outer


def test_near_dedup_of_a_base_and_its_copies(spark):
    rows = hub_family(500)
    _, find = components(rows)
    assert sum(find(d) == 0 for d, *_ in rows) > 500
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != find(r["doc_id"])] == []


def test_near_dedup_of_a_long_base_and_thousands_of_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(1004)]
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 3001):
        w = list(base)
        for x in rnd.sample(range(5, 999), 14):
            w[x] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w), "a"))
    frame = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(8)
    assert near_dedup.near_duplicates(frame).where("component_id <> 0").count() == 0


def test_texts_that_fool_weak_hashes_are_no_copies(spark):
    a, b = thue_morse()
    rows = [(1, a, "a"), (2, b, "a"), (3, a, "a")]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_regions_are_deepened():
    values = lambda *rows: np.array([sum((x & 0xFFFF) << 16 * (3 - i) for i, x in enumerate(r)) for r in rows], np.uint64).view(np.int64)
    head = np.array([1] * 8 + [2])
    tail = values((1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 2, 1), (1, 2, 0, 0), (1, 2, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (4, 0, 0, 0))
    assert near_dedup.common_prefix(head, tail).tolist() == [7, 6, 5, 8, 4, 4, 4, 0]
    pad = np.zeros(near_dedup.REACH + 1, np.int64)
    depth, size = near_dedup.regions(np.concatenate([pad, near_dedup.common_prefix(head, tail), pad]), 1)
    assert size.tolist() == [2, 3, 5, 2, 6, 6, 6, 6][: len(size)] or size.tolist()[:7] == [2, 3, 5, 2, 6, 6, 6]


def test_near_dedup_of_a_crowd_without_a_base(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 30)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 40)
    rows = [r for r in hub_family(150) if r[0] != 1000]
    _, find = components(rows)
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != find(r["doc_id"])] == []


def test_signatures_are_held_to_the_threshold_asked_for():
    for percent in (50, 60, 80, 85, 95):
        p = percent / 100
        assert 6 <= (p - near_dedup.least_agreement(percent)) / (p * (1 - p) / near_dedup.PERMUTATIONS) ** 0.5 <= 7


def test_near_dedup_of_the_small_table(spark, texts):
    sets, find = components([(d, t, None) for d, t in texts.items()])
    for r in near_dedup.op10_near_dedup(spark, SMALL).collect():
        assert r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]])


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(600)], "id long, key string")
    held = spark.createDataFrame([("hot", 1, "x"), ("k0", 2, None), ("k6", None, "z"), ("never", 4, "w")], "key string, a int, b string")
    got = common.spread_join(rows, held, ["key"])
    told = {"hot": (1, "x"), "k0": (2, None), "k6": (None, "z")}
    assert {r["id"]: (r["key"], r["a"], r["b"]) for r in got.collect()} == {i: (k, *told.get(k, (None, None))) for i, k in rows.collect()}
    joined = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["id", "key", "a", "b"] and "__salt" in joined.split("SortMergeJoin" if "SortMergeJoin" in joined else "HashJoin")[1].split("\n")[0]
    assert common.spread_join(rows.limit(0), held, ["key"]).count() == 0


def test_components_of_many_partitions(spark):
    rnd = random.Random(12)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    frame = spark.createDataFrame(edges, "u long, v long").repartition(8)
    got = {r["id"]: r["component"] for r in connected_components(frame, rows=30).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(8), 1, rows=10)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 30)] + [(30, 29), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in [5, *range(10, 31)]) and 7 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_queries_match_their_oracles(spark):
    import duckdb

    from chronofold.llm.queries import QUERIES, SQL

    db = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in SQL.items():
        a, b = QUERIES[name](spark, SMALL).toPandas(), db.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b), name


def test_line_keys_are_made_once_and_kept_only_if_shared(spark, monkeypatch):
    """Keys dealt by ranges would be sampled, for which all of them are made a second time."""
    import pyarrow as pa

    sent = pa.RecordBatch.from_pydict({"key": pa.array([1, 2, 2, 3], pa.int64()), "line": pa.array([7, 7, 8, 9], pa.int64()), "code": pa.array([0, 1, 1, 2], pa.int32())})
    assert [r for b in lines._shared(iter([sent])) for r in b.to_pylist()] == [{"line": 7, "code": 1}, {"line": 8, "code": 1}]
    docs = table(spark, line_rows())
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda *a: pytest.fail("line keys were sampled"))
    assert lines.drop_lines(docs).where("n_dropped > 0").count()
