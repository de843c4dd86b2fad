import itertools
import random
import unicodedata

import held_out
import held_out_answers
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotusflow.llm import answers, common, conversations, encoding, lookalikes, neighbours, packing, pii, splitting
from lotusflow.llm.conversations import kahn_order

# --- similar vectors


def brute_neighbours(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        s = (x @ x[a]).round(7)
        best = sorted((-s[b], j) for b, j in enumerate(ids) if j != i and s[b] >= least)
        out[i] = [j for _, j in best[:k]]
    return out


def test_neighbours_on_one_list_are_exact(spark):
    rng = np.random.default_rng(3)
    vectors = {f"c{i:03d}": rng.normal(size=8).astype("float32").tolist() for i in range(80)}
    vectors["c500"] = vectors["c010"]
    rows = [(k, v, "x") for k, v in vectors.items()] * 2 + [("n", None, "x"), ("z", [0.0] * 8, "x"), ("s", [1.0], "x"), ("q", [float("nan")] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "key string, v array<float>, list string")
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 8, 4).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == brute_neighbours(vectors, 4, -1)


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 2
    vectors = {f"{i:05d}": (centres[i % 40] + rng.normal(size=16)).astype("float32").tolist() for i in range(4000)}
    df = spark.createDataFrame(list(vectors.items()), "key string, v array<float>")
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 16, 5, list_size=100).collect():
        got.setdefault(r.id, set()).add(r.other)
    sample = sorted(vectors)[::40]
    x = np.array(list(vectors.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(vectors)
    hits = 0
    for s in sample:
        like = x @ x[ids.index(s)]
        best = [ids[j] for j in np.argsort(-like)[:6] if ids[j] != s][:5]
        hits += len(set(best) & got[s])
    assert hits / (5 * len(sample)) >= 0.9


def test_a_dense_group_takes_no_lists_from_the_others(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    others = [(centres[i % 40] + rng.normal(size=16)).astype("float32") for i in range(4000)]
    one = rng.normal(size=16) * 2
    dense = [(one + 0.1 * rng.normal(size=16)).astype("float32") for _ in range(2000)]
    x = np.array(others + dense)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "key string, v array<float>")
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 16, 5, list_size=60).collect():
        got.setdefault(int(r.id), set()).add(int(r.other))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    like = x[:4000:10] @ x.T
    hits = sum(len({int(j) for j in np.argsort(-row)[:6] if j != i} & got[i]) for i, row in zip(range(0, 4000, 10), like, strict=True))
    assert hits / (5 * len(like)) >= 0.92


def test_hot_copies_meet_without_their_group(spark):
    rng = np.random.default_rng(6)
    vectors = {f"h{i:03d}": [1.0, 2.0, 3.0, 4.0] for i in range(100)} | {f"r{i:03d}": rng.normal(size=4).astype("float32").tolist() for i in range(50)}
    vectors["near"] = [1.0, 2.0, 3.0, 4.01]
    df = spark.createDataFrame(list(vectors.items()), "key string, v array<float>")
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 4, 5, hot_copies=10).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["h007"] == ["h000", "h001", "h002", "h003", "h004"]
    assert got["h000"] == ["h001", "h002", "h003", "h004", "h005"]
    assert got["near"] == ["h000", "h001", "h002", "h003", "h004"]
    assert set(got) == set(vectors)


def test_copies_of_one_direction_are_hot_whatever_their_norm(spark, monkeypatch):
    rng = np.random.default_rng(6)
    one = rng.normal(size=16)
    vectors = {f"h{i:03d}": (one * rng.uniform(0.001, 1000)).astype("float32").tolist() for i in range(400)}
    vectors |= {f"r{i:03d}": rng.normal(size=16).astype("float32").tolist() for i in range(50)}
    df = spark.createDataFrame(list(vectors.items()), "key string, v array<float>")
    entering = []
    place = neighbours._assign
    monkeypatch.setattr(neighbours, "arrow_map", lambda d, f, schema, kept=neighbours.arrow_map: (f.__qualname__.startswith(place.__name__) and entering.append(d.count())) or kept(d, f, schema))
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 16, 5, hot_copies=10).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.other, r.cosine))
    assert got["h007"] == [(f"h00{i}", 1.0) for i in range(5)]
    assert set(got) == set(vectors) and entering[0] < 150
    assert spark.createDataFrame([([3e38, -1.0, 1e38],), ([3e-38, -1e-76, 1e-38],)], "v array<float>").select(neighbours.direction_hash(F.col("v"))).distinct().count() == 1


def recall(got, x, ids, rows, k=5):
    hits = 0
    for i in rows:
        like = x @ x[i]
        like[i] = -2
        hits += len({ids[j] for j in np.argsort(-like)[:k]} & got.get(ids[i], set()))
    return hits / (k * len(rows))


def neighbour_sets(df, dim, **settings):
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", dim, 5, **settings).collect():
        got.setdefault(r.id, set()).add(r.other)
    return got


def test_centroids_grow_beyond_the_sample_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = np.array([centres[i % 60] + 0.7 * rng.normal(size=16) for i in range(6000)], np.float32)
    ids = [f"{i:05d}" for i in range(len(x))]
    made = []
    kept = neighbours.Placement
    monkeypatch.setattr(neighbours, "Placement", lambda graph, *a: made.append(len(graph.centres)) or kept(graph, *a))
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "key string, v array<float>")
    # 300 sampled vectors fit 4 coarse centroids; the workers make the other lists.
    got = neighbour_sets(df, 16, list_size=60, sample_rows=300, cell_sample=2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert made[0] >= 90
    assert recall(got, x, ids, range(0, 6000, 60)) >= 0.9


def test_long_lists_are_cut_into_blocks_without_a_loss(spark):
    rng = np.random.default_rng(9)
    vectors = {f"c{i:04d}": rng.normal(size=8).astype("float32").tolist() for i in range(300)}
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()] * 2, "key string, v array<float>")
    got = {}
    for r in neighbours.similar_vectors(df, "key", "v", 8, 4, list_size=1000, block=37).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == brute_neighbours(vectors, 4, -1)


def test_every_pair_of_a_cut_list_meets_once():
    graph = neighbours.Graph(np.eye(2, dtype=np.float32), np.eye(2, dtype=np.float32))
    place = neighbours.Placement(graph, 2, 2, np.ones(2), np.ones(2))
    place.cut(np.array([50, 3]), 12)
    at, marks = np.array([0] * 50 + [1] * 3), np.arange(53) * 7
    searches = np.arange(53) % 3 > 0
    copy, cell, role = place.cells(at, searches, marks)
    met = [(a, b) for c in np.unique(cell) for a in copy[(cell == c) & (role & 1 > 0)] for b in copy[(cell == c) & (role & 2 > 0)]]
    assert sorted(met) == [(a, b) for a in range(53) for b in range(53) if searches[a] and at[a] == at[b]]
    assert max(np.unique(cell, return_counts=True)[1]) < 35


def test_rows_of_one_key_with_other_vectors_are_all_compared(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.1, 1.0]), ("d", [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    got = neighbour_sets(df, 2)
    assert got["a"] == {"b", "c", "d"} and got["b"] == {"a", "c", "d"}
    two = {(r.id, r.rank): (r.other, r.cosine) for r in neighbours.similar_vectors(df, "key", "v", 2, 1).collect()}
    assert two["b", 1][0] == "a" and two["c", 1][0] == "a" and two["a", 1][0] in ("b", "c")


def test_a_hot_direction_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    one = rng.normal(size=16)
    others = (rng.normal(size=(60, 16))[rng.integers(0, 60, 20_000)] + 0.6 * rng.normal(size=(20_000, 16))).astype("float32")
    hot = (one * rng.uniform(0.01, 100, size=(10_000, 1))).astype("float32")
    x = np.concatenate([others, hot])
    ids = [f"{i:06d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "key string, v array<float>").repartition(4)
    got = neighbour_sets(df, 16, list_size=300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(got, x, ids, range(0, 20_000, 100)) >= 0.9
    assert got[ids[20_000]] == set(ids[20_001:20_006])
    assert all(got[i] == set(ids[20_000:20_005]) for i in ids[20_005:])


def test_neighbours_of_an_empty_table(spark):
    assert neighbours.similar_vectors(spark.createDataFrame([], "key string, v array<float>"), "key", "v", 4).count() == 0


# --- splitting


def test_pieces_keep_limit_overlap_and_every_token():
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice(["ab ", "c. ", "d\n", "e\n\n", "f! ", "# g ", "h" + chr(0xA0)]) for _ in range(r.randint(0, 200)))
        limit, overlap = r.choice([(10, 0), (12, 4), (30, 9)])
        pieces = splitting.split_text(text, limit, overlap)
        total = splitting.count_tokens(text)
        if total <= limit:
            assert pieces == [(0, len(text), total)]
            continue
        words = splitting._TOKEN.findall(text)
        at = 0
        for no, (a, b, n) in enumerate(pieces):
            own = splitting._TOKEN.findall(text[a:b])
            assert len(own) == n <= limit
            first = at - (min(overlap, at) if no else 0)
            assert own == words[first : first + n]
            at = first + n
        assert at == total


def test_natural_boundaries_win():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(8)) + "." for i in range(4))
    pieces = splitting.split_text(text, 10, 1)
    assert [text[b - 1] for _, b, _ in pieces] == ["."] * 4


def test_merging_takes_weak_boundaries_first():
    assert splitting.merge_segments([3, 3, 3, 3], [4, 1, 3, 1], 6) == [0, 2]
    assert splitting.merge_segments([3, 3, 3], [4, 3, 1], 6) == [0, 1]
    assert splitting.merge_segments([9], [4], 6) == [0]


def test_split_rows(spark):
    rows = [("t", "a", "w " * 20, 1), ("t", "b", None, 1), ("t", "c", "", 1), ("t", "d", " \u3000 ", 1), ("t", "a", "w " * 20, 1)]
    df = spark.createDataFrame(rows, "tbl string, id string, content string, pieces int")
    got = splitting.split_items(df, 10, 2).collect()
    assert sorted({(r.id, r.pieces) for r in got}) == [("a", 3), ("b", 1), ("c", 1), ("d", 1)]
    assert splitting.split_items(df.limit(0), 10, 2).count() == 0
    with pytest.raises(ValueError):
        splitting.split_text("a", 10, 10)


# --- look-alikes


def test_classes_are_transitive():
    text = "aàếoĐ е̂́ѐ ｅ Ð Ɖ ο о\u00a0\u200b"
    counts = {c: 1 + text.count(c) for c in text} | {c: 50 for c in "aàếoèĐ e"}
    rewrite = lookalikes.Rewriter(lookalikes.build_classes(counts))
    assert rewrite("е̂́") == "ế" and rewrite("ѐ") == "è" and rewrite("ｅ") == "e"
    assert rewrite("ÐƉ") == "ĐĐ" and rewrite("οо") == "oo" and rewrite("a\u00a0b\u200b") == "a b"
    assert rewrite("e\u200b\u0302\u0301") == "ế"
    assert rewrite(None) is None and rewrite("") == ""


def test_rewriting_is_stable_and_keeps_differences():
    letters = "abAB01éeế \n\tоｅÐ\u0301\u0323\u200bㅤ"
    counts = {c: 5 for c in letters}
    rewrite = lookalikes.Rewriter(lookalikes.build_classes(counts))
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(letters) for _ in range(8))
        once = rewrite(t)
        assert rewrite(once) == once
    for a, b in [("a", "A"), ("e", "é"), ("0", "O"), ("a b", "a  b"), ("a\nb", "a\n\nb"), ("1", "l"), ("ế", "ề")]:
        assert rewrite(a) != rewrite(b)


@pytest.mark.parametrize("text", ["ещё моё её объём Ёлка", "її їжак Україні ї ёж", "naïve Citroën ещё її"])
def test_accented_lookalikes_come_to_an_end(text):
    # Cyrillic letters with accents more frequent than the Latin ones, base letters less.
    for often in ("ёїЁ", "еіоЁё", "ëïaeio"):
        rules = lookalikes.build_classes({c: 9 for c in text + "aàếoeiëï\u0308"} | {c: 500 for c in often})
        parts = {unicodedata.normalize("NFD", a): unicodedata.normalize("NFD", b) for a, b in rules.items()}
        assert not [b for a, b in parts.items() if a != b and any(parts.get(c, c) != c for c in b)]
        rewrite = lookalikes.Rewriter(rules)
        assert rewrite(rewrite(text)) == rewrite(text)
        latin = text.translate(str.maketrans("ёїеіо", "ëïeio"))
        assert rewrite(latin) == rewrite(text) == rewrite(unicodedata.normalize("NFD", text))


@pytest.mark.parametrize("text", ["한국어", "آب ؤ", "को ক়ো", "ế"])
def test_separate_parts_of_any_script_are_composed(text):
    apart = unicodedata.normalize("NFD", text)
    rewrite = lookalikes.Rewriter(lookalikes.build_classes({c: 1 for c in text + apart}))
    assert apart != text and rewrite(apart) == rewrite(text)


def test_emoji_keep_their_joiners():
    family = "👨\u200d👩"
    rewrite = lookalikes.Rewriter(lookalikes.build_classes({c: 1 for c in family + "ab"}))
    assert rewrite(family) == family and rewrite("a\u200db") == "ab"


def test_lookalike_pairs_against_brute_force(spark):
    r = random.Random(8)
    swap = {"a": "а", "o": "ο", " ": "\u00a0", "é": "e\u0301", "t": "ｔ"}
    rows = []
    for i in range(120):
        t = "".join(r.choice("ato é") for _ in range(3)) + "x"
        rows.append((f"t{i % 2}", f"{i:03d}", "".join(swap[c] if c in swap and r.random() < 0.3 else c for c in t)))
    rows += [("t0", "zz", None), ("t0", "yy", "..."), ("t0", "xx", ""), rows[0]]
    df = spark.createDataFrame(rows, "tbl string, id string, content string")
    rules = lookalikes.build_classes(lookalikes.point_frequency(df.select("content")))
    got = {tuple(x) for x in lookalikes.lookalike_pairs(df, rules).distinct().collect()}
    plain = lambda t: unicodedata.normalize("NFC", "".join({v: k for k, v in swap.items()}.get(c, c) for c in t))
    real = {x for x in rows if x[2] and any(c.isalnum() for c in x[2])}
    want = {(a[0], a[1], b[1]) for a, b in itertools.permutations(real, 2) if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and plain(a[2]) == plain(b[2])}
    assert got == want and want
    rows_of = lookalikes.lookalike_classes(df, rules).collect()
    assert len(rows_of) == len({(r.tbl, r.id, r.spelling_id) for r in rows_of}) == len({(t, i) for t, a, b in want for i in (a, b)})
    links = {(r.tbl, r.id): r.links for r in rows_of}
    assert all(n == sum((t, i) in ((x, a), (x, b)) for x, a, b in want) for (t, i), n in links.items())
    classes = {(r.tbl, r.id): r.class_id for r in rows_of}
    assert all(classes[t, a] == classes[t, b] for t, a, b in want)


def test_a_look_of_half_the_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "CLASS_ROWS", 7)
    rows = [("t", f"{i:03d}", "xin ch\u00e0o" if i % 5 else "xin cha\u0300o") for i in range(60)] + [("t", f"r{i}", f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows * 2, "tbl string, id string, content string")
    rules = lookalikes.build_classes(lookalikes.point_frequency(df.select("content")))
    got = sorted(tuple(x) for x in lookalikes.lookalike_pairs(df, rules).collect())
    ids = [f"{i:03d}" for i in range(60)]
    assert got == sorted({("t", a, b) for a in ids for b in ids if a < b and (int(a) % 5 == 0) != (int(b) % 5 == 0)})


def test_only_repeated_rows_are_moved(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), (None, "n"), (None, "n")]
    got = common.distinct_rows(spark.createDataFrame(rows, "id string, content string"), ["id"]).collect()
    assert sorted((r.id or "", r.content) for r in got) == [("", "n"), ("a", "x"), ("a", "y"), ("b", "z")]


# --- conversations


def test_kahn():
    order, left = kahn_order(["a", "b", "c", "d"], {"b": "a", "c": "a", "d": "c"}, {"b": 2, "c": 1})
    assert order == ["a", "c", "d", "b"] and left == []
    assert kahn_order(["a", "b"], {"a": "b", "b": "a"}, {})[1] == ["a", "b"]
    assert kahn_order(["a"], {"a": "gone"}, {})[1] == ["a"]


def test_stamps_and_cycles_change_the_order():
    def thread(stamps, parents):
        roles = {m: "assistant" if m.startswith("a") else "user" for m in stamps}
        return conversations.check_thread(parents, stamps, roles)

    parents = {"a1": "q1", "q2": "a1", "q3": "a1", "a2": "q2", "a3": "q3"}
    early = thread({"q1": 1, "a1": 2, "q2": 3, "a2": 4, "q3": 5, "a3": 6}, parents)
    assert early == (["q1", "a1", "q2", "a2", "q3", "a3"], set(), set(), set())
    # With the second branch first, and both questions before either answer, the roles stop alternating.
    late = thread({"q1": 1, "a1": 2, "q2": 4, "a2": 6, "q3": 3, "a3": 5}, parents)
    assert late == (["q1", "a1", "q3", "q2", "a3", "a2"], set(), {"a2"}, set())
    cycle = thread({"q1": 1, "a1": 2, "q2": 3, "a2": 4, "q3": 5}, {"a1": "q1", "q2": "q3", "q3": "a2", "a2": "q2"})
    assert cycle == (["q1", "a1"], {"q2", "a2", "q3"}, set(), {"q3"})


def test_turns_of_one_number_are_ordered_by_their_stamps():
    turns = [(1, "x", 5, True, True), (1, "y", 3, True, True), (2, "z", 1, True, True)]
    places = {key: (place, reached) for key, place, reached, _, _ in conversations.order_turns(turns, True)}
    assert places == {"y": (0, True), "z": (2, True), "x": (4, True)}
    turns[0] = (1, "x", 2, True, True)
    places = {key: place for key, place, *_ in conversations.order_turns(turns, True)}
    assert places == {"x": 0, "z": 2, "y": 4}
    assert [r[2] for r in conversations.order_turns([(1, "x", 1, True, True), (3, "y", 2, True, True), (4, "z", 3, True, True)], True)] == [True, False, False]


def turn_rows(spark, rows):
    return spark.createDataFrame(
        [(*r, 1) for r in rows], "id string, session_id string, turn_no int, question string, answer string, intent int"
    ).withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))


def test_reasons(spark):
    rows = [
        ("1", "good", 1, "q", "a"), ("2", "good", 2, "q", "a"), ("2", "good", 2, "q", "a"),
        ("3", "gap", 1, "q", "a"), ("4", "gap", 3, "q", "a"), ("5", "twice", 1, "q", "a"), ("6", "twice", 1, "q", "a"),
        ("7", "null", None, "q", "a"), ("8", "blank", 1, " ", "\u200b"), ("9", "open", 1, "q", "..."), ("10", "orphan", 1, None, "a"),
        ("11", "stranger", 1, "q", "a"), ("12", "late", 1, "q", None), ("12", "late", 1, "q", "a"), ("13", None, 1, "q", "a"), ("14", "zero", 0, "q", "a"),
    ]
    known = spark.createDataFrame([(s,) for s in "good gap twice null blank open orphan late zero nothing".split()] * 2, "session_id string")
    for block in (1, 4096):
        got = {tuple(r) for r in conversations.dropped_sessions(turn_rows(spark, rows), known, block).collect()}
        assert got == {
            ("gap", "broken"), ("twice", "broken"), ("null", "broken"), ("blank", "empty"), ("open", "missing_reply"), ("orphan", "broken"),
            ("stranger", "broken"), ("zero", "broken"), ("nothing", "empty"),
        }
    sound = conversations.conversation_messages(turn_rows(spark, rows), known).where("session_id = 'good'").orderBy("message_no")
    assert [(r.message_no, r.role) for r in sound.collect()] == [(1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")]


def test_long_sessions_in_blocks_equal_one_block(spark):
    r = random.Random(2)
    rows = []
    for s in range(30):
        n = r.randint(1, 40)
        for t in range(1, n + 1):
            if r.random() > 0.02:
                rows.append((f"{s}-{t}", f"s{s}", t, "q", "a" if r.random() > 0.02 else None))
    known = spark.createDataFrame([(f"s{s}",) for s in range(30)], "session_id string")
    results = [{tuple(x) for x in conversations.dropped_sessions(turn_rows(spark, rows), known, b).collect()} for b in (3, 7, 4096)]
    assert results[0] == results[1] == results[2]


def test_no_turns_and_no_sessions(spark):
    none = spark.createDataFrame([], "session_id string")
    assert conversations.dropped_sessions(turn_rows(spark, []), none).count() == 0


# --- answers


@pytest.fixture(scope="module")
def tagger():
    places = [f"Hồ {a} {b}" for a in ("Yên", "Lam", "Mây", "Sao") for b in ("Sơn", "Khê", "Giang")]
    rows = []
    for p in places:
        rows += [
            (f"Giá vé vào {p} là bao nhiêu?", f"Vé vào {p} hiện là 50.000 đồng cho người lớn. Trẻ em được giảm một nửa, và vé có giá trị trong ngày."),
            (f"{p} nằm ở đâu?", f"{p} nằm ở phía tây thành phố Yên Bình, cách trung tâm khoảng 20 km. Bạn có thể đi thuyền máy để tới nơi trong 10 phút."),
            (f"Mùa nào đẹp nhất để đi {p}?", f"Thời gian đẹp nhất để ghé {p} là từ tháng 3, khi trời ấm và ít mưa."),
            (f"How much is the entrance to {p}?", f"The entrance to {p} costs 50.000 đồng for adults. Children pay half, and the ticket is valid for one day."),
        ]
    return answers.train_tagger(rows)


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Giá vé?", None, "empty"),
        ("Giá vé?", " \u200b ... ", "empty"),
        ("Hồ Yên Sơn nằm ở đâu?", "Hồ Yên Sơn nằm ở đâu?", "copy"),
        ("Hồ Yên Sơn nằm ở đâu?", "Câu hỏi: hồ yên sơn nằm ở đâu", "copy"),
        ("Hồ Yên Sơn nằm ở đâu?", "Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"),
        ("Hồ Yên Sơn nằm ở đâu?", "The road to Hồ Yên Sơn is quiet and there are many places to eat. You should visit in the morning.", "other_language"),
        ("Viết bằng tiếng Anh về Hồ Yên Sơn.", "The road to Hồ Yên Sơn is quiet and there are many places to eat.", None),
        ("Hồ Yên Sơn nằm ở đâu?", "Hồ Yên Sơn nằm ở phía tây thành phố Yên Bình, cách trung tâm khoảng 20 km. Bạn có thể đi thuyền máy để tới nơi trong 10 phút.", None),
        ("Giá vé vào Hồ Yên Sơn là bao nhiêu?", "Vé vào Hồ Yên Sơn hiện là 50.000 đồng cho người lớn. Trẻ em được giảm một nửa, và vé có giá trị trong ngày", None),
        ("Giá vé vào Hồ Yên Sơn là bao nhiêu?", "Vé vào Hồ Yên Sơn hiện là 50.000 đồng cho người lớn. Trẻ em được giảm một", "truncated"),
        ("Giá vé vào Hồ Yên Sơn là bao nhiêu?", "Vé vào Hồ Yên Sơn hiện là 50.000 đồng cho người lớn (xem thêm", "truncated"),
    ],
)
def test_defects(tagger, question, answer, defect):
    assert tagger.defects(answers.Tokens(), [question], [answer]) == [defect]


def test_held_out_answers(spark):
    """Written apart from the training phrases; the field sees pairs of a small corpus."""
    turns = spark.read.parquet("/root/testdata/sf0.01/chat_turns.parquet")
    taught = answers.train_tagger(answers.sample_pairs(turns), known=answers.known_words(turns, "answer"))
    got = taught.defects(answers.Tokens(), [c[0] for c in held_out_answers.CASES], [c[1] for c in held_out_answers.CASES])
    right = [c[2] for c in held_out_answers.CASES]
    for kind in ("empty", "truncated", "refusal", "copy", "other_language"):
        hit = sum(g == r == kind for g, r in zip(got, right, strict=True))
        assert hit / right.count(kind) >= 0.8 and hit / got.count(kind) >= 0.8, kind
    assert sum(g == r for g, r in zip(got, right, strict=True)) / len(right) >= 0.9


def test_known_words_come_from_all_answers(spark):
    df = spark.createDataFrame([("Bạn nên ghé quán cá",), ("Một hai ba",), (None,), ("",)] * 3, "answer string").repartition(3)
    known = answers.known_words(df, "answer")
    marked = lambda w: bool(known[answers._hash(answers.fold(w)) % answers.WORD_BITS])
    assert [marked(w) for w in ("ban", "quán", "hai", "cá", "ba")] == [True, True, True, False, False] and known.sum() == 6


def test_long_answers_teach_and_an_early_bracket_counts(tagger):
    long = " ".join(f"Vé {i} có giá 50.000 đồng cho người lớn." for i in range(60))
    assert answers.train_tagger([("Giá vé là bao nhiêu?", long)] * 3).defects(answers.Tokens(), ["Giá vé là bao nhiêu?"], [long]) == [None]
    far = answers.Clauses(answers.Tokens(), ["q"], ["Xem bảng (" + "giá vé cho người lớn và trẻ em " * 5])
    near = answers.Clauses(answers.Tokens(), ["q"], ["Xem bảng (" + "giá vé cho người lớn và trẻ em " * 5 + ")"])
    assert far.dense[-1].tolist() != near.dense[-1].tolist()


def test_defective_rows(spark, tagger):
    turns = turn_rows(spark, [("1", "s", 1, "q", None), ("1", "s", 1, "q", "Vé vào cổng hiện là 20.000 đồng cho người lớn."), ("2", "s", 2, "q", ""), (None, "s", 3, "q", None)])
    results = spark.createDataFrame(
        [("r", "q?", "Xin lỗi, tôi không thể trả lời câu hỏi này.", "refuse"), ("t", "q?", "Xin lỗi, tôi không thể trả lời câu hỏi này.", None)],
        "id string, question string, answer string, expected_behavior string",
    )
    got = {tuple(r) for r in answers.defective_answers(turns, results, tagger).collect()}
    assert got == {("chat_turns", "2", "empty"), ("eval_results", "t", "refusal")}
    assert answers.defective_answers(turns.limit(0), results.limit(0)).count() == 0


def test_gradient_of_the_field():
    """Training lowers the loss and finds the labels of a separable problem."""
    from lotusflow.llm.crf import ChainCRF

    rng = np.random.default_rng(1)
    gold = rng.integers(0, 2, 600)
    dense = np.stack([np.ones(600), gold + rng.normal(size=600) * 0.1], 1).astype(np.float32)
    crf = ChainCRF(2, 2, 8)
    starts, none = np.zeros(601, np.int64), np.zeros(0, np.int64)
    lengths = np.full(200, 3)
    crf.fit(dense, none, none.astype(np.float32), starts, lengths, gold, epochs=30, batch=64, rate=0.1)
    assert (crf.decode(crf.emissions(dense, none, none.astype(np.float32), starts), lengths) == gold).mean() > 0.99


# --- encoding


def test_encoding_equals_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    own = encoding.tokenizer()
    other = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZER_PATH}/{encoding.TOKENIZER}.json")
    other.encode_special_tokens = True
    r = random.Random(7)
    alphabet = "aeinđạ  \n\t01.,'<|>😀中é\u0301"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += ["<|endoftext|>", "it's THEY'RE", "   x  ", "ab" * 3000, "đạ" * 2000, "\r\n\r\n", "a" * 5000]
    assert [own.encode(t) for t in texts] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_pair_tree_gives_the_leftmost_lowest():
    r = random.Random(1)
    values = [r.randint(0, 9) for _ in range(37)]
    tree = encoding.PairTree(values)
    for _ in range(200):
        i = r.randrange(37)
        values[i] = r.randint(0, 9)
        tree.put(i, values[i])
        assert tree.lowest() == min((v, i) for i, v in enumerate(values))


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "xin chào", "i"), (2, "", "i"), (3, None, "i")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_texts(df, "doc_id", "text").collect()}
    assert got[1] and got[2] == [] and got[3] == []
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- packing


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 40)
    r = random.Random(9)
    rows = [(i, r.choice([0, 1, 5, 7, 7, 7, 7, 33, 50, 64, 100, 130, 200])) for i in range(700)] + [(900, None), (901, -3)]
    made = packing.pack_items(spark.createDataFrame(rows, "k long, n_tokens int"), "k", 64).collect()
    bins, items = {}, {}
    for x in made:
        items.setdefault(x.k, []).append((x.part_no, x.start, x["size"]))
        bins.setdefault(x.bin_id, []).append(x)
    for k, n in rows:
        n = max(0, n or 0)
        parts = sorted(items[k])
        assert sum(p[2] for p in parts) == n and len(parts) == max(1, -(-n // 64))
        assert [p[1] for p in parts] == [64 * i for i in range(len(parts))]
    for inside in bins.values():
        used = sum(x["size"] for x in inside)
        assert {x.bin_used for x in inside} == {used} and len({x.bin_length for x in inside}) == 1 and used <= inside[0].bin_length <= 64
    total = sum(max(0, n or 0) for _, n in rows)
    assert len([b for b in bins.values() if sum(x["size"] for x in b)]) <= 1.1 * total / 64 + 1


def test_packing_without_items(spark):
    assert packing.pack_items(spark.createDataFrame([], "k long, n_tokens int"), "k", 64).count() == 0
    only = packing.pack_items(spark.createDataFrame([(1, 0)], "k long, n_tokens int"), "k", 64).collect()
    assert [(x.bin_id, x.bin_used) for x in only] == [(0, 0)]


def test_plan_uses_up_the_histogram():
    r = random.Random(3)
    for _ in range(50):
        histogram = {r.randint(1, 100): r.randint(1, 50) for _ in range(20)}
        left = dict(histogram)
        for length, times, used, contents in packing.plan_bins(histogram, [25, 50, 100]):
            assert sum(contents) == used <= length
            for s in contents:
                left[s] -= times
        assert not any(left.values())


# --- personal information


@pytest.fixture(scope="module")
def recognizer():
    return pii.train_recognizer()


def test_held_out_sentences(recognizer):
    """Written apart from the training patterns, with other names."""
    true, found, hit = {}, {}, {}
    for text, right in held_out.cases():
        got = {(k, v) for k, v, _, _ in recognizer.find(text)}
        for counted, some in ((true, right), (found, got), (hit, got & right)):
            for kind, _ in some:
                counted[kind] = counted.get(kind, 0) + 1
    for kind in pii.KINDS:
        assert hit[kind] / true[kind] >= 0.9 and hit[kind] / found[kind] >= 0.9, kind


def test_scores_are_the_sums_of_the_named_features(recognizer):
    for text, _ in held_out.cases()[:12]:
        doc = pii.Text(text)
        for c, scored in zip(pii.candidates(doc), recognizer.scores(pii.candidates(doc)), strict=True):
            kind, shape, left, right = c[2:]
            names = [kind, *(f"{kind}|{f}" for f in (*shape, *pii.left_features(left), *pii.right_features(right)))]
            assert scored[:3] == c[:3] and scored[3] == pytest.approx(sum(recognizer.weights.get(f, 0.0) for f in names))


def test_long_names_and_addresses_are_candidates_as_a_whole():
    name = "Nguyễn Phúc Bảo Long Hoàng Minh Khang Thái"
    place = "12 đường " + ", phường ".join(["Tân Phú Đông Hưng Thịnh"] * 12)
    spans = {(k, text[s:e]) for text in (f"Gặp {name} ở cổng.", f"Ở {place}.") for s, e, k, *_ in pii.candidates(pii.Text(text))}
    assert ("name", name) in spans and ("address", place) in spans


def test_the_corpus_teaches_its_own_surroundings():
    rows = [f"Biển kỷ niệm ghi {n} nhé." for n in ("Trần Văn Nam", "Lê Thị Hoa", "Phạm Minh Tuấn", "Vũ Đức Long", "Đặng Thu Hà")] * 30
    taught = pii.train_recognizer(rows)
    assert [v for _, v, _, _ in taught.find("Biển kỷ niệm ghi Zorel Quintar nhé.")] == ["Zorel Quintar"]


def test_sentences_of_the_training_patterns(recognizer):
    hit = found = true = 0
    for text, gold in pii.training_samples(copies=4, seed=2024):
        got = set(recognizer.segments(pii.Text(text)))
        hit, found, true = hit + len(got & gold), found + len(got), true + len(gold)
    assert hit / found > 0.97 and hit / true > 0.97


def test_values_stand_as_in_the_text(recognizer):
    text = "Liên hệ chị Vũ Thị Hoa qua số ０９１２３４５６７８ để giữ chỗ. Gửi thư về hoa.vu (at) mail (dot) example trước 9 giờ nhé."
    got = {(k, v) for k, v, _, _ in recognizer.find(text)}
    assert got == {("name", "Vũ Thị Hoa"), ("phone", "０９１２３４５６７８"), ("email", "hoa.vu (at) mail (dot) example")}
    apart = unicodedata.normalize("NFD", text)
    for _, v, s, e in recognizer.find(apart):
        assert apart[s:e] == v
    assert ("name", unicodedata.normalize("NFD", "Vũ Thị Hoa")) in {(k, v) for k, v, _, _ in recognizer.find(apart)}


def test_masking(recognizer):
    text = "Nhà trọ ở 12 phố Lam Sơn còn hai phòng trống. Giá combo 2@575k áp dụng đến 30/04/2025."
    assert recognizer.mask(text) == "Nhà trọ ở [ADDRESS] còn hai phòng trống. Giá combo 2@575k áp dụng đến 30/04/2025."
    assert recognizer.mask(None) is None and recognizer.mask("") == ""


def test_best_segments_against_all_subsets():
    r = random.Random(5)
    for _ in range(200):
        scored = []
        for _ in range(r.randint(0, 8)):
            s = r.randint(0, 10)
            scored.append((s, s + r.randint(1, 5), "k", r.uniform(-1, 3)))
        best = max(
            (sum(c[3] for c in sub) for n in range(len(scored) + 1) for sub in itertools.combinations(scored, n)
             if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(sub, 2))), default=0,
        )
        got = pii.best_segments(scored)
        value = {c[:3]: max(d[3] for d in scored if d[:3] == c[:3]) for c in scored}
        assert sum(value[g] for g in got) == pytest.approx(max(best, 0))


def test_personal_rows(spark, recognizer):
    df = spark.createDataFrame([(1, "Review by Anna Smith: calm place, kind staff.", "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, kind string")
    assert [(r.doc_id, r.kind, r.value) for r in pii.find_personal(df, "doc_id", "text", recognizer).collect()] == [(1, "name", "Anna Smith")]
    assert {r.doc_id: r.text for r in pii.mask_personal(df, "doc_id", "text", recognizer).collect()}[2] is None
    assert pii.find_personal(df.limit(0), "doc_id", "text", recognizer).count() == 0


def test_every_query_runs_on_the_small_tables(spark):
    from lotusflow.llm import queries

    for name, f in queries.queries().items():
        assert f(spark, "/root/testdata/sf0.001").count() >= 0, name
