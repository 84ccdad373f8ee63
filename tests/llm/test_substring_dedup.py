import random
import re
import tracemalloc

import numpy as np

from recurq.llm import substring_dedup as s


def brute_centres(x, width):
    out = []
    for c in range(len(x)):
        a = b = c
        while a > 0 and x[a - 1] >= x[c]:
            a -= 1
        while b + 1 < len(x) and x[b + 1] >= x[c]:
            b += 1
        if b - a + 1 >= width:
            out.append(c)
    return out


def test_centres_are_the_nodes_of_the_cartesian_tree_that_hold_a_passage():
    rng = np.random.default_rng(0)
    for n in (0, 3, 10, 200):
        x = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        for width in (2, 5, 10, 46):
            assert s.centres(x, width).tolist() == brute_centres(x.tolist(), width)


def fold(text):
    text = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", text)


def exact_repeats(docs, n=50):
    seen = {}
    for d, t in docs:
        w = fold(t)
        for k in range(len(w) - n + 1):
            seen.setdefault(" ".join(w[k : k + n]), set()).add((d, k))
    out = {}
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, k in places:
                out.setdefault(d, set()).update(range(k, k + n))
    return out


def test_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    extra = " ".join(f"word{i}" for i in range(55))
    docs += [(900, f"{docs[0][1][:900]} {extra} tail one"), (901, f"other head {extra} and {docs[1][1][:700]}"), (902, None), (903, ""), (904, extra[:200]), (905, f"x{extra} {extra}x"), (905, docs[7][1])]
    edited = extra.split()
    edited[20] = "changed"
    docs.append((906, "some lead in here " + " ".join(edited + [f"more{i}" for i in range(20)])))
    got = {}
    for r in s.repeated_passages(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, other int")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.after_word))
    want = exact_repeats([x for x in docs if x[0] != 905])
    assert set(want) <= set(got)
    # a passage reaches as far as its document shares it with the least member of a key
    assert sum(len(places & got[d]) for d, places in want.items()) >= 0.95 * sum(map(len, want.values()))
    near = exact_repeats(docs, 30)  # a near copy of 50 words holds a long exact run
    assert all(d in near or d == 906 for d in got)
    assert 900 in got and 901 in got and 904 not in got


def test_repeats_within_one_document_only(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{text} {text}"), (2, "short text"), (None, text)], "doc_id long, text string")
    assert s.repeated_passages(df).collect() == []
    assert s.repeated_passages(df.limit(0)).collect() == []


def test_every_anchor_of_a_passage_with_an_insertion_or_deletion_is_settled():
    rng = np.random.default_rng(5)
    width = 46

    def shingled(tokens):
        return np.array([hash(tuple(tokens[k : k + 5])) & 0xFFFFFFFF for k in range(len(tokens) - 4)], np.uint32)

    def best(x, y, i, j):
        """The best similarity of two passages at one shift around the places, by trying all of them."""
        out = 0.0
        for k in range(max(0, i - width + 1), i + 1):
            m = k + j - i
            if k + width <= len(x) and 0 <= m and m + width <= len(y):
                p, q = x[k : k + width].tolist(), y[m : m + width].tolist()
                common = sum(min(p.count(v), q.count(v)) for v in set(p))
                out = max(out, common / (2 * width - common))
        return out

    settled = 0
    for edit in ("insert", "delete"):
        for at in range(1, 50, 3):
            passage = rng.integers(0, 1 << 40, 51 if edit == "delete" else 50).tolist()
            other = passage[:at] + [-1] + passage[at:] if edit == "insert" else passage[:at] + passage[at + 1 :]
            x, y = (shingled(rng.integers(0, 1 << 40, 30).tolist() + p + rng.integers(0, 1 << 40, 30).tolist()) for p in (passage, other))
            places = {v: j for j, v in enumerate(y.tolist())}
            for i, j in [(i, places[v]) for i, v in enumerate(x.tolist()) if v in places]:
                found, left_out = s.passages(x, y, np.array([i]), np.array([j]), width, 0.8)
                assert bool(found) == (not left_out[0]) == (best(x, y, i, j) >= 0.8), (edit, at, i, j)
                settled += bool(found)
    assert settled > 500


def test_exact_repeats_are_not_lost_to_a_stranger_of_the_same_line(spark):
    rng = np.random.default_rng(6)

    def text(n):
        return [f"w{k}" for k in rng.integers(0, 1 << 40, n)]

    line, docs, want = text(40), [], set()
    docs.append((0, " ".join(text(30) + line + text(30))))  # the least id has the line only
    for group in range(60):
        passage = text(5) + line + text(5)
        for _ in range(2):
            docs.append((len(docs), " ".join(text(30) + passage + text(30))))
            want.add(docs[-1][0])
    # one that verifies against the least document, and one that repeats 50 words of it but not of the least
    lead, words, tail = text(30), text(60), text(30)
    edited = words.copy()
    edited[5] = "changed"
    for t in (lead + words + text(20), text(25) + edited + tail, text(25) + edited[10:] + tail[:5] + text(20)):
        docs.append((len(docs), " ".join(t)))
        want.add(docs[-1][0])
    got = {r.doc_id for r in s.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_near_copies_are_not_lost_to_strangers_of_the_same_line(spark):
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randrange(3, 9))) for _ in range(n)]

    docs, pairs = [], []
    for g in range(60):
        line, before = words(40), rng.randrange(11)
        passage = words(before) + line + words(10 - before)
        edited, at = list(passage), rng.randrange(2, 48)
        edited[at : at + (g % 3 != 1)] = [] if g % 3 == 2 else words(1)  # one word replaced, inserted or deleted
        pairs.append((len(docs), len(docs) + 1))
        for p in [passage, edited] + [line] * 20:
            docs.append((len(docs), " ".join(words(rng.randrange(10, 60)) + p + words(rng.randrange(10, 60)))))
    found = {r.doc_id for r in s.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found <= {x for pair in pairs for x in pair}
    assert sum(a in found and b in found for a, b in pairs) >= 0.9 * len(pairs)


def test_near_copies_that_agree_inside_two_outer_stretches_of_others_share_a_key():
    rng = np.random.default_rng(12)
    a, b = (rng.integers(0, 1 << 32, 91, dtype=np.uint64) for _ in range(2))
    a[20:71] = b[20:71]  # the outer places on both sides are those of other documents
    c, width = np.array([45]), 46
    repeated = ~np.zeros(1 << (s._FILTER_BITS - 6), np.uint64)  # all stretches repeat somewhere
    one, two = (s.flank_keys(h, c, width, repeated) for h in (a, b))
    assert set(one[0]) == set(s.flank_keys(a, c, width)[0])
    assert set(one[0]) & set(two[0])
    assert (one[1] == 45).all()


def test_verifying_many_pairs_takes_memory_for_some_tiles_at_a_time():
    rng = np.random.default_rng(13)
    text, pairs = rng.integers(0, 1 << 32, 460, dtype=np.uint64).astype(np.uint32), 4000
    sides = s.Sides([text] * pairs)
    pair, c = np.repeat(np.arange(pairs), 20), np.tile(np.arange(0, 460, 23), pairs)
    tracemalloc.start()
    found, similar, left_out = s.shared_passages(sides, sides, pair, c, c, 46, 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == [[k, 0, 460, 0, 460] for k in range(pairs)] and (similar == 1).all() and not left_out.any()
    assert most < 60e6


def test_rows_do_not_depend_on_how_much_is_done_at_once(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, s.repeated_passages(df).collect()))
    for name, value in (("_TILES", 500), ("_ANCHORS", 3000), ("_SHINGLES", 20000), ("_LEFT", 300)):
        monkeypatch.setattr(s, name, value)
    assert want and sorted(map(tuple, s.repeated_passages(df).collect())) == want
