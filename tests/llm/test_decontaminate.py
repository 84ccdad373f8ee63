import random

import numpy as np
import pyarrow as pa

from recurq.llm import decontaminate as d
from recurq.llm.wordhash import buffers, words


def slow_least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_least_edits_matches_the_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert d.least_edits(item, text)[0] == slow_least_edits(item, text)


def brute_pairs(docs, items, similarity=0.8):
    def fold(texts):
        data, offsets = buffers(pa.array(texts, pa.string()))
        w = words(data, offsets, 0, len(texts))
        return [d.folded(w, w.first[i], w.first[i + 1]) for i in range(len(texts))]

    out = set()
    for (did, _), text in zip(docs, fold([t for _, t in docs]), strict=True):
        for (iid, _), item in zip(items, fold([t for _, t in items]), strict=True):
            if item and d.least_edits(item, text)[0] <= len(item) * (1 - similarity) + 1e-9:
                out.add((did, iid))
    return out


def test_against_brute_force(spark, sf_dir):
    rng = random.Random(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t[:3000]) for i, t in docs[:60]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "Zyxwv kolmogorov plim")]
    for k, (_, t) in enumerate(items[:20]):
        w = [x if rng.random() > 0.06 else "changed" for x in t.split()]
        docs.append((5000 + k, docs[k][1][:500] + " " + " ".join(w) + " " + docs[k + 1][1][:500]))
    docs += [(6000, None), (6001, ""), (6002, "see zyxwv, KOLMOGOROV plim."), (6002, "see zyxwv, KOLMOGOROV plim.")]
    got = d.contaminated(spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string").drop("item_id"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    pairs = {(r.doc_id, r.item_id) for r in rows}
    want = brute_pairs(docs, items)
    assert pairs == want
    assert all(r.similarity >= 0.8 for r in rows)
    assert sum(r.doc_id == 6002 for r in rows) == 2
    kept = d.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {p for p, _ in pairs})


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, items).collect() == []
    assert d.contaminated(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).collect() == []


def matched(items, docs):
    data, offsets = buffers(pa.array(docs, pa.string()))
    return {(t, i) for t, i, *_ in d.Matcher(list(enumerate(items)), 0.8).search(words(data, offsets, 0, len(docs)))}


def word(rng, least=2, most=9):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))


def test_recall_up_to_the_full_distance():
    rng = random.Random(8)
    for n in (6, 8, 12, 16, 20, 38):
        items, docs = [], []
        for _ in range(150):
            item = " ".join(word(rng) for _ in range(n))
            edits = set(rng.sample(range(len(item)), int(len(item) * rng.uniform(0.1, 0.2))))
            items.append(item)
            docs.append(" ".join(word(rng) for _ in range(20)) + " " + "".join(rng.choice("abcdefghij") if k in edits and c != " " else c for k, c in enumerate(item)) + " " + " ".join(word(rng) for _ in range(20)))
        want, got = {(k, k) for k, (i, t) in enumerate(zip(items, docs, strict=True)) if d.least_edits(i, t)[0] <= len(i) * 0.2 + 1e-9}, matched(items, docs)
        assert len(want) == 150
        assert got >= want, n


def test_a_copy_of_an_item_of_short_words():
    items = ["If x is 3 and y is 4 what is x + y", "if a is 2 and b is 7 and c is 1 then what is a + b + c or a * b - c", "3 + 4 = 7 ; 5 + 6 = 11 ; 7 + 8 = 15 ; 9 + 1 = 10"]
    docs = [f"Here it is: {t} so there" for t in items]
    assert matched(items, docs) == {(k, k) for k in range(3)}


def test_many_edit_distances_match_one_by_one():
    rng = random.Random(5)
    patterns = [[rng.randrange(4) for _ in range(n)] for n in (1, 3, 63, 64, 65, 130, 200)]
    texts = [[rng.randrange(5) for _ in range(rng.randint(0, 150))] for _ in range(60)]
    which = [rng.randrange(len(patterns)) for _ in texts]
    for k in range(0, 60, 3):  # some hold the pattern with a few changes
        copy = [x for x in patterns[which[k]] if rng.random() > 0.1]
        texts[k] = texts[k][:20] + copy + texts[k][20:]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    letters = np.array([x for t in texts for x in t], np.int64)
    edits, ends = d.many_least_edits([np.array(p) for p in patterns], np.array(which), letters, bounds, 4)
    for k, t in enumerate(texts):
        # letter 4 stands for those that no pattern has
        want = d.least_edits("".join("abcd"[x] for x in patterns[which[k]]), "".join("abcdz"[x] for x in t))
        assert (edits[k], ends[k]) == want


def test_short_items_and_recall_at_the_edge_in_whole_documents(spark):
    """Through Spark, with corpus counts: verbatim items of short words are all found, and edits of 15 to 20 % in nine of ten cases."""
    rng = random.Random(12)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    short = ["to be or not to be that is the q", "If x is 3 and y is 4 what is x + y", "a of the in and to it is", "1 2 3 4 5 6"]
    items += [(7000 + k, t) for k, t in enumerate(short)]
    rows, want = [(i, t, i % 7, None) for i, t in docs], set()
    for k, (i, t) in enumerate(items):
        if i >= 7000:
            rows.append((100_000 + k, f"{docs[k][1]}\n{t}\n{docs[k + 1][1]}", 1, "x"))
            want.add((100_000 + k, i))
            continue
        for rate in (0.15, 0.17, 0.19):
            edits = set(rng.sample(range(len(t)), int(len(t) * rate)))
            edited = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if p in edits else c for p, c in enumerate(t))
            rows.append((200_000 + int(rate * 100) * 1000 + k, f"{docs[k][1]}\n{edited}\n{docs[k + 1][1]}", 1, "x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id long, similarity string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got
    edited = [r for r in rows if r[0] >= 200_000]
    planted = brute_pairs_of_planted(edited, items)
    assert len(planted) > 100
    for rate in (15, 17, 19):
        here = {p for p in planted if p[0] // 1000 == 200 + rate}
        assert len(here & got) >= 0.9 * len(here), rate


def brute_pairs_of_planted(rows, items):
    """The pairs of each edited document and its own item that verify."""
    out = set()
    for did, text, *_ in rows:
        out |= brute_pairs([(did, text.split("\n", 1)[1] if "\n" in text else text)], [items[did % 1000]])
    return out


def test_a_very_long_text_and_repeated_items(spark):
    rng = random.Random(9)
    item = " ".join(word(rng, 4) for _ in range(15))
    filler = " ".join(word(rng) for _ in range(20_000))
    text = f"{(filler + ' ') * 45}{item} {filler}"
    assert len(text) > 5_000_000
    df = spark.createDataFrame([(1, text), (1, text[:100]), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(3, item)] * 3 + [(4, None)], "item_id int, text string")
    got = d.contaminated(df, items, block_items=2).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.after_word - r.first_word) for r in got] == [(1, 3, 0, 15)] * 3


def test_words_do_not_depend_on_the_pieces():
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "Bcd", "\u00c9t\u00e9", "x" * 5000, "...", "\u4e2d\u6587", "12"]) for _ in range(3000))
    texts = [text, "", "one two", text[:9000]]
    data, offsets = buffers(pa.array(texts, pa.string()))
    whole, pieces = words(data, offsets, 0, 4), words(data, offsets, 0, 4, piece=1000)
    for name in ("data", "starts", "ends", "hashes", "first"):
        assert (getattr(whole, name) == getattr(pieces, name)).all(), name


def test_items_with_an_edit_in_every_word_are_all_found():
    """No word is left to tell them, so only pieces of words can."""
    rng = random.Random(21)
    items = [" ".join(word(rng, 5, 7) for _ in range(n)) for n in (2, 3, 5, 8, 13, 21, 40) for _ in range(8)]
    docs = [f"{word(rng)} {word(rng)} {' '.join(w[:k] + '0' + w[k + 1 :] for w in t.split() for k in [rng.randrange(len(w))])} {word(rng)}" for t in items]
    want = brute_pairs(list(enumerate(docs)), list(enumerate(items)))
    assert len(want) > 40
    assert matched(items, docs) == want


def test_all_that_verify_are_found():
    """Edits of any kind up to the allowed distance, letters of two bytes and an item that ends in another text."""
    rng = random.Random(22)
    items = [" ".join(word(rng, 1, 8) + rng.choice(["", "é", "中"]) for _ in range(n)) for n in (1, 2, 4, 9, 20, 45) for _ in range(6)]
    docs = []
    for k, t in enumerate(items * 4):
        rate = rng.uniform(0.05, 0.21)
        edited = "".join(rng.choice(["", c + "q", "v", " "]) if rng.random() < rate else c for c in t)
        docs += [f"{word(rng)} {edited} {word(rng)}", edited[: len(edited) // 2], edited[len(edited) // 2 :]]
    want = brute_pairs(list(enumerate(docs)), list(enumerate(items)))
    assert len(want) > 60
    assert matched(items, docs) == want


def test_items_that_may_be_edited_as_a_whole():
    """Without a character that must stay there are no pieces, and every text with a word is within the distance."""
    items, docs = ["abc def", "", "q", "long words here"], ["zzz yyy", "", "x", "...", "abc"]
    found = words(*buffers(pa.array(docs, pa.string())), 0, len(docs))
    for similarity in (0.0, 0.1, 0.5):
        got = {(t, i) for t, i, *_ in d.Matcher(list(enumerate(items)), similarity).search(found)}
        assert got == {(t, i) for t, i in brute_pairs(list(enumerate(docs)), list(enumerate(items)), similarity) if docs[t].strip(".")}, similarity


def test_a_text_ends_with_its_last_word():
    """No space follows it that an item could be told by."""
    items = ["kolmogo rovstel wxyz", "brackish tangibl abcd"]
    docs = ["see kolmogo rovstel", "see kolmogo rovstel and", "brackish tangibl a"]
    got = matched(items, docs)
    assert got == brute_pairs(list(enumerate(docs)), list(enumerate(items))) == {(1, 0), (2, 1)}
