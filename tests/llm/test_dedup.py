"""Line dedup, Jaccard join and suffix dedup against brute force, and on odd rows."""

import random
from collections import Counter

import pytest

from papyra.llm import jaccard, suffix_dedup
from papyra.llm.components import components, few_components
from papyra.llm.jaccard import jaccard_components
from papyra.llm.line_dedup import dedup_lines
from papyra.llm.suffix_dedup import blind_trie, deep_shallow, remove_repeats

from .helpers import documents, linked_components, no_docs, odd_docs, shingles


def keep_lines(texts: list[tuple[int, str]]) -> dict[int, str]:
    first, gone = {}, {}
    for i, t in sorted(texts):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            if any(x.strip(" ") for x in w):
                if w in first:
                    gone.setdefault(i, set()).update((p, p + 1, p + 2))
                first.setdefault(w, (i, p))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in texts}


def test_line_dedup_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark)).collect()}
    assert got == keep_lines(rows)


def test_line_dedup_odd_rows(spark):
    rows = dedup_lines(odd_docs(spark).withColumnRenamed("lang", "covered")).collect()
    assert len(rows) == 11 and 'covered' in rows[0]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and by[1][0].n_lines == 4
    assert [(r.n_removed, r.n_spans, r.text) for r in by[2]] == [(4, 1, "")] * 2
    assert by[3][0].text is None and by[3][0].n_lines == 0 and by[4][0].n_lines == 0
    assert dedup_lines(no_docs(spark)).count() == 0


def test_line_dedup_blank_windows_stay(spark):
    docs = spark.createDataFrame([(1, "\n\n\n\na"), (2, "\n\n\n\nb")], "doc_id long, text string")
    assert {r.text for r in dedup_lines(docs).collect()} == {"\n\n\n\na", "\n\n\n\nb"}


def test_jaccard_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = {r.doc_id: r.component_id for r in jaccard_components(documents(spark)).collect()}
    assert got == linked_components(texts)


def make_variants(seed: int, n: int) -> list[tuple[int, str]]:
    """Groups of near copies that drift apart, over a passage that all of them share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(25)]
    rows, text = [], [rng.choice(words) for _ in range(60)]
    for i in range(n):
        if i % 12 == 0:
            text = [rng.choice(words) for _ in range(60)]
        text = list(text)
        text[rng.randrange(60)] = rng.choice(words)
        if rng.random() < 0.3:
            text[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join((passage if i % 2 else []) + text)))
    return rows


@pytest.mark.parametrize("common", [1, 5])
def test_jaccard_drifting_groups(spark, monkeypatch, common):
    """Chains of links, a passage in half of the documents, small leaves and a low bound for common shingles."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "LEAF", 3)
    rows = make_variants(3, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == linked_components(dict(rows))


def test_jaccard_large_region_closes_in_blocks(spark, monkeypatch):
    """A region that pivots leave open is finished in blocks of members, in as few stages as any other."""
    monkeypatch.setattr(jaccard, "SIDE", 16)
    monkeypatch.setattr(jaccard, "WIDE", 64)
    names: list[str] = []
    stored = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: names.append(name) or stored(df, name))
    rows = make_variants(7, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == linked_components(dict(rows))
    assert names.count("pivots") <= 1 and "closing" in names


def test_jaccard_blocks_spare_pairs_that_are_known_or_meet_elsewhere(spark, monkeypatch):
    """Every pair of two components meets in a block, and a group of one component is not replicated to its own blocks."""
    monkeypatch.setattr(jaccard, "SIDE", 16)
    # regions 1, 2 and 3 hold nearly the same members, of one large component and a few others; 4 is small, 5 is done
    regions = {1: range(0, 400), 2: range(5, 395), 3: range(5, 380), 4: range(396, 404), 5: range(100, 200)}
    rows = [(r, n, 10) for r, nodes in regions.items() for n in nodes]
    closing = spark.createDataFrame(rows, "region long, node long, n long")
    roots = {n: 0 if 8 <= n < 392 else n for n in range(404)}
    found = spark.createDataFrame([(n, r) for n, r in roots.items() if r == 0], "node long, root long")
    dealt, copies = jaccard._dealt(closing, found)
    dealt = dealt.collect()
    assert copies == sum(r.copies for r in dealt) < 4 * sum(map(len, regions.values())) and {r.region for r in dealt} <= {1, 2, 3, 4}
    blocks = {}
    for r in dealt:
        for k in range(r.copies):
            blocks.setdefault((r.region, min(r.own, k), max(r.own, k)), []).append(r)
    met = {(min(x.node, y.node), max(x.node, y.node)) for (_, i, j), b in blocks.items()
           for x in b if x.own == i for y in b if y.own == j and x.node != y.node}
    wanted = {(a, b) for nodes in regions.values() for a in nodes for b in nodes if a < b and roots[a] != roots[b]}
    assert wanted <= met
    assert max(sum(r.node == n for r in b) for b in blocks.values() for n in (b[0].node,)) == 1


def test_jaccard_odd_rows(spark):
    rows = jaccard_components(odd_docs(spark)).collect()
    assert len(rows) == 11
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got[1][1] == got[2][1] == 1
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (1, 6) and got[8] == (1, 8)
    assert jaccard_components(no_docs(spark)).count() == 0


def test_jaccard_few_links_need_no_rounds(spark, monkeypatch):
    """The links of a step join in one task as far as they are few, and in rounds beyond, to the same components."""
    rows = make_variants(11, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names: list[str] = []
    monkeypatch.setattr("papyra.llm.components.stage", lambda df, name, f=jaccard.stage: names.append(name) or f(df, name))
    for few, rounds in ((jaccard.FEW, False), (0, True)):
        monkeypatch.setattr(jaccard, "FEW", few)
        got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
        assert got == linked_components(dict(rows)) and ("star" in names) == rounds


def test_few_components_as_by_rounds(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(40)] + [(i, i - 1) for i in range(1060, 1000, -1)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([*pairs, (5000, 5000)], "a long, b long").repartition(5)
    got = sorted(map(tuple, few_components(links).collect()))
    assert got == sorted(map(tuple, components(links).collect())) and len(got) == len(dict(got))
    assert few_components(links.where("a < 0")).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(texts: list[bytes], length: int) -> list[tuple[bytes, int]]:
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), runs))
    return out


@pytest.mark.parametrize("hot", [1, 512])
def test_suffix_dedup_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    shared = ["".join(rng.choice("abc ") for _ in range(n)) for n in (399, 400, 401, 430, 900)]
    texts = ["x" * 1300, "é" * 350, "ab" * 400, "", "short"]
    for i in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 700)))
        texts.append(own + rng.choice(shared)[rng.randrange(3):] + own[:rng.randrange(500)] + str(i))
    texts += [texts[10], texts[10], texts[20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))


def test_suffix_dedup_hot_core_without_repeats(spark, monkeypatch):
    """Many texts share a core shorter than a window, and nothing else."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rng = random.Random(5)
    core = "".join(rng.choice("abcd ") for _ in range(395))
    texts = [f"{i:04d}" * 10 + core + f"{i:04d}" * 40 for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))


def test_suffix_dedup_odd_rows(spark):
    rows = remove_repeats(odd_docs(spark)).collect()
    assert len(rows) == 11
    got = {r.doc_id: r for r in rows}
    assert got[3].n_bytes == 0 and got[3].spans == [] and bytes(got[6].kept) == b"" and len(got[6].spans) == 1
    assert remove_repeats(no_docs(spark)).count() == 0


def test_orders_of_strings():
    rng = random.Random(0)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [b"a" * 30] * 5
    rows = list(range(len(strings)))
    wanted = sorted(strings)
    assert [strings[r] for r in blind_trie(strings, rows)] == wanted
    for depth in (0, 3, 100):
        assert [strings[r] for r in deep_shallow(strings, rows, depth)] == wanted


def growing_chain(tag: str) -> tuple[list[str], list[str]]:
    """((p, m, u, w), texts that make shingles common): p-m, m-u and u-w link, and sizes alone rule p-u out.

    Blocks between four z's have shingles of their own: a block of k words has k + 4. Of p's and w's shingles only those
    that both share with u are not common, so p is in every region of u and w.
    """
    size = {"x": 68, "a": 6, "b": 30, "c": 28, "e": 9, "d": 5}
    block = {k: " ".join(f"{tag}{k}{i}" for i in range(n - 4)) for k, n in size.items()}
    of = [" z z z z ".join(["", *(block[k] for k in held), ""]).strip() for held in ("xab", "xabed", "xbced", "xce")]
    often = []
    for k in "abce":
        w = f"z z z z {block[k]} z z z z".split()
        often += [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] * (jaccard.COMMON + 1)
    return of, often


def test_jaccard_chain_of_growing_sets(spark):
    """The distance of u to the pivot p is not computed; its lower bound must not drop u before it meets w."""
    texts = {}
    for n in range(6):
        chain, often = growing_chain(f"h{n}")
        if n == 0:
            assert [len(shingles(t)) for t in chain] == [104, 118, 140, 105]
        texts |= {10 * n + i: t for i, t in enumerate(chain)} | {1000 * (n + 1) + i: t for i, t in enumerate(often)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(3, "doc_id")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs.sortWithinPartitions("doc_id")).collect()}
    chains = {i: t for i, t in texts.items() if i < 1000}
    assert {i: got[i] for i in chains} == linked_components(chains) == {i: i // 10 * 10 for i in chains}


# pairs that share 6 of 7 shingles each, one of them early on, at which 24 bits of their class marks agree
ALIKE = [("b13w", 15958, 10786), ("b18w", 14889, 5694), ("b20w", 3642, 7309)]


def test_jaccard_class_marks_that_agree_in_24_bits(spark):
    """Two holders of a shingle in one task, and in two tasks."""
    texts = [" ".join([f"{w}{i}" for i in range(10)] + [f"t{n}"]) for w, *ends in ALIKE for n in ends]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 2), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
