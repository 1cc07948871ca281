"""Near, exact, substring and suffix dedup against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from evenkeel.llm import cuckoo, jaccard, lines, minimisers, superkmers, suffixes
from evenkeel.llm.graph import components
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.fixtures import empty, prose, table, texts, vocabulary


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_groups_of_similar_texts(docs, rows, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, width, percent).collect()}
    assert got == brute.similar_groups(rows, width, percent)


def test_every_pair_at_the_threshold_shares_a_signature():
    """Also with many segments, empty parts and one-deletion segments."""
    rng = np.random.default_rng(3)
    scheme = jaccard.Scheme(80)
    for size in [2, 3, 5, 6, 8, 11, 17, 30, 64, 150, 700]:
        for _ in range(30):
            a = rng.integers(1, 2**63, size, dtype=np.uint64)
            most = int(size * 0.2)
            drop = int(rng.integers(0, most + 1))
            more = 0
            while 100 * (size - drop) >= 80 * (size + more + 1):
                more += 1
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, int(rng.integers(0, more + 1)), dtype=np.uint64)])
            if not jaccard.linked(np.unique(a), np.unique(b), 80) or (drop == 0 and len(b) == size):
                continue
            sets = [np.unique(a), np.unique(b)]
            places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            sigs, owner = scheme.signatures(np.concatenate(sets), places)
            assert set(sigs[owner == 0].tolist()) & set(sigs[owner == 1].tolist()), size


def test_one_of_each_group_stays_with_its_columns(spark, docs, rows):
    kept = jaccard.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    want = {c for _, c in brute.similar_groups(rows, 4, 85).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("block,star,direct", [(7, 512, 100), (7, 3, 2), (2, 2, 1)])
def test_clumps_are_compared_block_against_block(spark, monkeypatch, block, star, direct):
    """Many unlike texts that share signatures, in blocks of a few, at once or thinned out first."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "STAR_SETS", star)
    monkeypatch.setattr(jaccard, "DIRECT_BLOCKS", direct)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    words = vocabulary(5)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[:6]) for _ in range(7))) for i in range(120)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(60):  # a family around the threshold: some pairs are linked, some not
        copy = list(base)
        for _ in range(rng.randint(2, 6)):
            copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 40)}"
        rows.append((1000 + i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.similar_groups(table(spark, rows), 2, 80).collect()}
    want = brute.similar_groups(rows, 2, 80)
    assert got == want and len({c for i, (_, c) in want.items() if i >= 1000}) > 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_components_of_random_graphs(spark):
    rng = random.Random(12)
    links = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(230)]
    links += [(a, b) for b, a in links[:40]] + [(999, 999)]
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket_runs", [8000, 1])
def test_bytes_seen_earlier_go(docs, rows, bucket_runs):
    got = suffixes.drop_earlier_seen(docs, 40, 12, bucket_runs).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got}
    assert got == brute.without_earlier(rows, 40)


@pytest.mark.parametrize("bucket_runs", [8000, 1])
def test_words_of_repeated_windows_go(docs, rows, bucket_runs):
    got = superkmers.drop_repeated_passages(docs, 9, 4, bucket_runs).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got}
    assert got == brute.without_repeated(rows, 9)


def test_common_prefixes_from_the_transform():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(12, 40))) for _ in range(30)]
    strings += strings[:3]
    data = "\0".join(strings) + "\0"
    text = np.array([0 if c == "\0" else ord(c) + 1 for c in data], np.int64)
    stops = np.flatnonzero(text == 0)
    ends = stops[np.searchsorted(stops, np.arange(len(text)))]
    order = suffixes.sorted_suffixes(text, ends)
    tails = [data[i:ends[i]] for i in range(len(data))]
    assert [tails[i] for i in order] == sorted(tails)
    for minimum in (3, 8, 12):
        want = [tails[a][:minimum] == tails[b][:minimum] and len(tails[a]) >= minimum
                for a, b in zip(order[:-1], order[1:])]
        assert suffixes.long_common_prefixes(text, order, minimum).tolist() == want


def test_exact_groups(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in cuckoo.exact_groups(docs).collect()}
    assert got == {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows}
    assert sorted(r.doc_id for r in cuckoo.unique_texts(docs).collect()) == sorted(max(g) for g in groups.values())


def test_cuckoo_filter_takes_in_and_out_and_grows():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    small = cuckoo.CuckooFilter.sized(10)
    grown = cuckoo.changed(small, digests, [], digests)
    assert grown.cells > small.cells and grown.held == 3000 and all(d in grown for d in digests)
    left = cuckoo.changed(grown, [], digests[:1000], digests[1000:])
    assert left.held == 2000 and all(d in left for d in digests[1000:])
    assert sum(d in left for d in digests[:1000]) < 20
    again = cuckoo.CuckooFilter(left.cells, left.to_bytes(), left.held)
    assert all(d in again for d in digests[1000:])


def test_index_follows_inserts_and_deletes(spark):
    index = cuckoo.CuckooIndex(spark, buckets=3)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.insert(docs((1, "a"), (2, "b"), (3, "a")))
    index.insert(docs((4, "c"), (5, "b")))
    look = lambda *t: {r.doc_id: (r.keep_id, r.group_size)
                       for r in index.lookup(docs(*enumerate(t))).collect()}
    assert look("a", "b", "c", "d") == {0: (3, 2), 1: (5, 2), 2: (4, 1), 3: (None, None)}
    index.delete(docs((3, "a"), (4, "c")))
    assert look("a", "b", "c") == {0: (1, 1), 1: (5, 2), 2: (None, None)}


def _plain_templates(rows, min_docs):
    """Lines that occur, as they are with digits masked, in enough documents."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            tokens = ["<*>" if re.search("[0-9]", w) else w for w in brute.WORD.findall(line)]
            if tokens:
                holders.setdefault(tuple(tokens), set()).add(i)
    return {k: min(v) for k, v in holders.items() if len(v) >= min_docs}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_recurring_lines_go_from_all_but_the_first(docs, rows, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LEAVES", broadcast)
    got = {r.doc_id: r for r in lines.drop_recurring(docs, 5).collect()}
    often = _plain_templates(rows, 5)
    assert any("<*>" in k for k in often)
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if often.get(tuple(
            "<*>" if re.search("[0-9]", w) else w for w in brute.WORD.findall(x)), i) == i]
        assert (got[i].text or "") == "\n".join(kept)
        assert got[i].n_chars == (None if t is None else len(got[i].text))


def test_variable_places_of_a_template(spark):
    rows = [(i, f"user {name} logged in from the office today\nown words of text number{i}x")
            for i, name in enumerate("anna bert carl dora emil fritz gerd hans".split())]
    out = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    assert {r.doc_id: r["__n_dropped"] for r in out} == {i: int(i > 0) for i in range(8)}


def _lines_beside(others):
    """One line in 100 documents with a variable word, and ``others`` in the same leaf."""
    out = [(i, f"we would like word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} to read one of our news today")
           for i in range(100)]
    return out + [(1000 + i, x) for i, x in enumerate(others)]


def _dropped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in lines.drop_recurring(df).collect() if r["__n_dropped"]}


def test_leaf_with_five_templates(spark):
    ends = ["send it all back home again", "buy some more green tea here", "see what others have just found",
            "join us on every second sunday"]
    rows = _lines_beside([f"we would like word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} to {end}"
                          for end in ends for i in range(100)])
    assert len({len(t.split()) for _, t in rows}) == 1
    assert _dropped(spark, rows) == {i for i, _ in rows} - {0, 1000, 1100, 1200, 1300}


def test_leaf_with_a_hot_line(spark):
    rows = _lines_beside(["we would like you all to know about this new offer"] * 300)
    assert _dropped(spark, rows) == {i for i, _ in rows} - {0, 1000}


def test_variable_words_that_are_frequent_elsewhere(spark):
    names, towns = [[x + y for x in "abcde" for y in end] for end in ("klmn", "pqrs")]
    pairs = [(n, t) for n in names for t in towns][::2]
    rows = _lines_beside([f"we would like {n} to come and visit us in {t}" for n, t in pairs])
    rows += [(5000 + i, "we would like wordak to come and visit us in ap") for i in range(2)]
    assert _dropped(spark, rows) == {i for i, _ in rows} - {0, 1000}


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    text = prose(rng, vocabulary(9), 120)
    rows = [(1, text), (1, text), (None, text), (2, prose(rng, vocabulary(9), 50)), (None, None)]
    df = table(spark, rows)
    groups = jaccard.similar_groups(df, 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in groups if r.doc_id) == [(1, 1), (1, 1), (2, 2)]
    assert sorted(str(r.component_id) for r in groups if r.doc_id is None) == ["1", "None"]
    assert jaccard.keep_one(df, 4, 85).count() == 3
    cut = suffixes.drop_earlier_seen(df).collect()
    assert [r.n_removed for r in cut if r.doc_id == 1] == [0, 0]
    assert {r.n_removed for r in cut if r.doc_id is None} == {0, len(text.encode())}
    words = superkmers.drop_repeated_passages(df).collect()
    assert [r.n_removed for r in words if r.doc_id == 1] == [120, 120]
    assert superkmers.drop_repeated_passages(table(spark, [(1, text), (1, text)])).agg(
        F.sum("n_removed")).first()[0] == 0
    assert sum(r.kept for r in cuckoo.exact_groups(df).collect() if r.doc_id == 1) == 2


def test_empty_tables(spark):
    none = empty(spark)
    for found in (jaccard.similar_groups(none), jaccard.keep_one(none), suffixes.drop_earlier_seen(none),
                  superkmers.drop_repeated_passages(none), cuckoo.exact_groups(none), lines.drop_recurring(none)):
        assert found.count() == 0


def test_pairs_of_blocks_take_turns(spark, monkeypatch):
    """Few bytes of copies at a time, and the same groups."""
    rng = random.Random(9)
    base = rng.sample(vocabulary(9), 60)
    rows = [(i, " ".join([*base[:i % 58], f"w{i}", *base[i % 58 + 1:]])) for i in range(40)]
    written = []
    kept = jaccard.write_scratch
    monkeypatch.setattr(jaccard, "write_scratch", lambda df, name: written.append(name) or kept(df, name))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "TURN_BYTES", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.similar_groups(table(spark, rows), 4, 60).collect()}
    assert got == brute.similar_groups(rows, 4, 60)
    assert written.count("links") > 2


def test_the_place_of_a_run_is_a_small_number():
    start, n = np.array([0, 70_000, 2**31 - 1]), np.array([1, 61, 100])
    at = minimisers.place_of(start, n, np.array([0, 3, 2]), (100).bit_length())
    assert at[1] < 2**32 and ((at >> 9) == start).all() and ((at >> 2 & 127) == n).all()
    assert (at & 3).tolist() == [0, 3, 2]


@pytest.mark.parametrize("size", [20, 60, 280, 1100])
def test_sets_without_a_common_shingle_share_no_signature(size):
    """Empty parts would make groups that grow with the number of sets."""
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(1, 2**63, size, dtype=np.uint64)) for _ in range(300)]
    places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sigs, owner = jaccard.Scheme(80).signatures(np.concatenate(sets), places)
    _, where = np.unique(sigs, return_inverse=True)
    met = np.unique(np.column_stack([where, owner]), axis=0)[:, 0]
    assert (np.bincount(met) > 1).sum() <= 5


@pytest.mark.parametrize("percent,paired", [(80, 64), (80, 1), (45, 64), (45, 1)])
def test_sketches_rule_out_no_linked_pair(monkeypatch, percent, paired):
    monkeypatch.setattr(jaccard, "PAIRED_SETS", paired)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(percent)
    sets = []
    for size in [1, 3, 40, 90, 91, 200, 700, 3000, 30_000]:
        base = rng.integers(1, 2**63, size, dtype=np.uint64)
        for share in [0, 0, 0.04, 0.08, 0.1, 0.15, 0.3, 0.5]:
            new = rng.integers(1, 2**63, int(size * share), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[len(new):] if size % 2 else base, new])))
    places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    known = jaccard.Sketched(np.diff(places), jaccard.sketches(np.concatenate(sets), places), percent)
    a, b = np.triu_indices(len(sets), 1)
    may = known.may_link(a, b)
    linked = np.array([jaccard.linked(sets[i], sets[j], percent) for i, j in zip(a, b, strict=True)])
    assert linked.sum() > 50 and may[linked].all() and may.mean() < 0.4
    owner = np.concatenate([np.arange(len(sets)), np.arange(0, len(sets), 3)])
    sig = np.repeat([5, 9], [len(sets), len(owner) - len(sets)])
    root = jaccard.alike_groups(sig, owner, known)
    up = np.arange(len(owner))
    for i in range(len(owner)):
        for j in range(i + 1, len(owner)):
            if sig[i] == sig[j] and known.may_link(owner[[i]], owner[[j]])[0]:
                up[up == max(up[i], up[j])] = min(up[i], up[j])
    assert (root == up).all()


def test_chance_meetings_send_no_texts(spark, monkeypatch):
    """Unlike texts with common passages share signatures; none of them is read for a comparison."""
    rng = random.Random(4)
    words = vocabulary(11)
    rows = [(i, " ".join([*words[:8], *(rng.choice(words) + str(rng.random()) for _ in range(30))])) for i in range(60)]
    rows += [(100 + i, rows[0][1] + f" w{i}") for i in range(2)]
    sizes, kept = {}, jaccard.write_scratch

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "write_scratch", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows), 4, 80).collect()}
    assert got == brute.similar_groups(rows, 4, 80)
    assert sizes["signatures"] > 20 and sizes["texts"] == 3


@pytest.mark.parametrize("ones", [1, 4, 9])
def test_one_deletion_segments_lose_no_pair(monkeypatch, ones):
    """Segments with one deletion, and spare ones, whatever the cost model would take."""
    scheme = jaccard.Scheme(80)
    monkeypatch.setattr(jaccard.Scheme, "plan", lambda self, k: (
        ones, max(0, self.most_apart(k) + 4 - 2 * ones), max(3, 2 * ones - self.most_apart(k) - 1)))
    rng = np.random.default_rng(ones)
    for size in [6, 11, 20, 40, 90]:
        for _ in range(60):
            a = rng.integers(1, 2**63, size, dtype=np.uint64)
            drop = int(rng.integers(0, size // 5 + 1))
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, int(rng.integers(0, 3)), dtype=np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            if not jaccard.linked(*sets, 80) or (len(b) == size and not drop):
                continue
            places = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            sigs, owner = scheme.signatures(np.concatenate(sets), places)
            assert set(sigs[owner == 0].tolist()) & set(sigs[owner == 1].tolist()), size


def test_runs_and_texts_of_plain_ids_are_dealt_out_once(spark):
    """Tables that meet by id are dealt out by id, not by a pair that the join cannot use."""
    body = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    docs = spark.createDataFrame([(i, body[i * 20:i * 20 + 400]) for i in range(1, 9)], "doc_id long, text string")
    found = suffixes.drop_earlier_seen(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan
    assert not re.search(r"hashpartitioning\(id#\d+L?, h#", plan)
    assert found.count() == 8
