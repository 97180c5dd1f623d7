import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dfprofile.llm import decontaminate, graph, jaccard, repeats


def variants(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((n, " ".join(text) + rng.choice(["", " ", "\n"])))
            n += 1
    return rows


def brute_groups(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(make_docs, width, percent):
    rows = variants() + [(900, "A b C"), (901, "a B c"), (902, "a b"), (903, "A B"), (904, ""), (905, None)]
    got = jaccard.similar_groups(make_docs(rows), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, width, percent)


@pytest.mark.parametrize("width,percent", [(3, 90), (1, 80)])
def test_jaccard_around_the_threshold_in_one_tile(make_docs, width, percent):
    """One passage in all texts, and copies whose edits leave them just within or just beyond."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for n in range(260):
        text = [f"own{n % 230}x{i}" for i in range(n % 9)] + passage[:90 - n % 7]
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice([f"q{n}", "common", passage[rng.randrange(90)]])
        rows.append((n, " ".join(text)))
    rows += [(1000 + n, " ".join(passage + [f"tail{n}y{i}" for i in range(n)])) for n in range(40)]
    want = brute_groups(rows, width, percent)
    assert 3 < len({c for _, _, c in want}) < 290
    got = jaccard.similar_groups(make_docs(rows), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_of_many_near_copies_verifies_few_pairs(make_docs, monkeypatch):
    """Copies that the first nodes of their tiles do not link are not expanded into all their pairs."""
    rng = random.Random(5)
    base = [f"p{i}" for i in range(200)]
    rows = []
    for n in range(240):
        text = list(base)
        for _ in range(rng.choice([2, 2, 3])):
            text[rng.randrange(200)] = f"q{rng.randrange(40)}"
        rows.append((n, " ".join(text)))
    verified, verify = [], jaccard._verify

    def counted(docs, reps, pairs, *args):
        verified.append(pairs.count())
        return verify(docs, reps, pairs, *args)

    monkeypatch.setattr(jaccard, "_verify", counted)
    got = jaccard.similar_groups(make_docs(rows), 5, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 5, 80)
    assert sum(verified) < 4 * len(rows), verified


def test_jaccard_of_chance_meetings_settles_small_tiles_at_once(make_docs, monkeypatch):
    """Tiles of a few nodes leave no rows to later turns, and few pairs need their whole signatures."""
    rng = random.Random(11)
    rows = [(n, " ".join(rng.sample([f"w{i}" for i in range(900)], 30))) for n in range(240)]
    rows += [(1000 + n, t + f" own{n}") for n, t in rows[:9]]
    left, screened, apart, screen = [], [], jaccard._apart, jaccard._screen
    monkeypatch.setattr(jaccard, "_apart", lambda df: left.append(apart(df)) or left[-1])
    monkeypatch.setattr(jaccard, "_screen", lambda pairs, *args: screened.append(pairs.count()) or screen(pairs, *args))
    got = jaccard.similar_groups(make_docs(rows), 1, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 1, 80)
    assert left == [(0, 0)] and sum(screened) < 3 * len(rows), (left, screened)


def test_components_of_stars_take_no_step(spark, monkeypatch):
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    edges = [(5, 1), (1, 9), (7, 2), (2, 7), (3, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and len(cuts) == 1


def test_jaccard_edge_rows(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = jaccard.similar_groups(edge_docs, 3, 90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 3, 90)


def test_one_of_each(make_docs, edge_docs, empty_docs):
    rows = variants(8)
    kept = jaccard.one_of_each(make_docs(rows), 5, 80)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {c for _, _, c in brute_groups(rows, 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    left = jaccard.one_of_each(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, 4, 5, 6, None, 8])
    assert jaccard.one_of_each(empty_docs).count() == 0 and jaccard.similar_groups(empty_docs, 3, 90).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {300: 300, 301: 300}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p:p + window]] > 1:
                gone[p:p + window] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def repeated_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (3, 8, 15, 30)]
    rows = []
    for i in range(25):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), word()]
        rows.append((i, " ".join(parts)))
    return rows + [(30, rows[3][1]), (31, "x" * 120), (32, "ab" * 90), (33, passages[3]), (3, rows[3][1])]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeats_equal_brute_force(make_docs, edge_docs, hot):
    rows = repeated_texts(6) + [(40, None), (41, ""), (None, "no id")]
    got = repeats.repeats(make_docs(rows), window=40, gram=16, hot=hot).collect()
    assert Counter(tuple(r) for r in got) == brute_repeats(rows, 40)


def test_repeats_in_long_texts(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    texts = [t.encode() for _, t in repeated_texts(9)]
    whole = [{(int(d), int(p), int(a), int(b)) for d, p, _, a, b in zip(*part)} for part in repeats.owners(texts, 40, 16)]
    windows = Counter((d, w, p) for part in whole for d, p, a, b in part for w in range(a, b + 1))
    assert set(windows.values()) == {1}
    assert {(d, w) for d, w, _ in windows} == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 39)}


def test_without_repeats(make_docs, edge_docs, empty_docs):
    rows = repeated_texts(7)
    out = repeats.without_repeats(make_docs(rows), window=40, gram=16)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    left = sum(n - g for (_, n, g, _, _), k in brute_repeats(rows, 40).items() for _ in range(k))
    assert 0 <= left - sum(len(r.text.encode()) for r in got) <= 4 * len(rows)  # characters cut in part
    assert repeats.without_repeats(edge_docs).columns == edge_docs.columns
    assert repeats.without_repeats(edge_docs).count() == 10
    assert repeats.repeats(empty_docs).count() == 0 and repeats.without_repeats(empty_docs).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item, text = (rng.integers(0, 4, rng.integers(1, 7)).astype(np.uint64) for _ in range(2))
        want = min(plain_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        d, a, b = decontaminate.edit_distance(item, text)
        assert d == want == plain_distance(item, text[a:b])


def test_contamination_recall(spark, make_docs, edge_docs, empty_docs):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60)))) for i in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, " ! ")], "item_id long, text string")
    rows, want = [], set()
    for i in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i < 90:
            k = i % 30
            w = items[k][1].split()
            for _ in range(rng.randint(0, len(w) // 10)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            body = [*body, *w, *(rng.choice(vocab) for _ in range(rng.randint(0, 30)))]
            want.add((i, k))
        rows.append((i, ("! " if i % 2 else " ").join(body).upper()))
    docs = make_docs(rows, extra=True)
    found = decontaminate.contamination(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert all(r.distance <= 0.2 * r.item_words for r in found)
    left = decontaminate.without_benchmark(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(range(150)) - {i for i, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(edge_docs, none).count() == 0
    assert decontaminate.without_benchmark(edge_docs, bench).count() == 10
    assert decontaminate.contamination(empty_docs, bench).count() == 0


def test_contamination_finds_every_item_at_the_limit(spark, make_docs):
    """Items of 1 to 40 words, exact and with exactly the allowed edits, mixed: all are found."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    items = {n * 10 + k: rng.sample(vocab, n) for n in range(1, 41) for k in range(6)}
    rows, want = [], {}
    for item, own in items.items():
        for edits in {0, len(own) // 5}:
            w = list(own)
            for e in range(edits):
                at, kind = rng.randrange(len(w)), rng.choice("sid")
                w[at:at + (kind != "i")] = [] if kind == "d" else [f"x{e}"]
            body = [f"y{rng.randrange(300)}" for _ in range(rng.randint(0, 7))]
            want[len(rows)] = item, plain_distance(own, w)
            rows.append((len(rows), " ".join([*body, *w, *body[::-1]])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(make_docs(rows), bench).collect()}
    missed = [(len(items[i]), d) for doc, (i, d) in want.items() if got.get((doc, i), 99) > d]
    assert not missed, Counter(missed)


def test_contamination_equals_brute_force(monkeypatch):
    """Few distinct words, so that keys collide often; collisions in many parts."""
    monkeypatch.setattr(decontaminate, "MOST_HITS", 7)
    rng = random.Random(13)
    for similarity in (0.6, 0.8, 1.0):
        text = lambda lo, hi: " ".join(rng.choice("abcd") for _ in range(rng.randint(lo, hi)))
        items, texts = [(i, text(1, 11).encode()) for i in range(25)], [text(0, 25) for _ in range(20)]
        index = decontaminate.Index(items, similarity)
        got = {(t, i): d for t, i, d, _, _ in decontaminate._matches(index, [t.encode() for t in texts], similarity)}
        want = {}
        for t, words in enumerate(x.split() for x in texts):
            for i, own in items:
                own = own.decode().split()
                d = min(plain_distance(own, words[a:b]) for a in range(len(words) + 1) for b in range(a, len(words) + 1))
                if d <= decontaminate.most_edits(len(own), similarity):
                    want[t, i] = d
        assert got == want
