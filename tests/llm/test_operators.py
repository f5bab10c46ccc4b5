import base64
import hashlib
import io
import random
import re
import subprocess
import sys
import zipfile
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import decontaminate, language_id, line_dedup, partenum, pii, quality_rules, sentence_piece, token_file, url_filter, warc
from grainmill.llm.queries import URL_BLOCKED, URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n int, cls string, c string, key string"


def table(spark, rows):
    """Documents with columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "r", 1, "x", "y", "z") for i, t, lang in rows], SCHEMA)


def split(text, lower=True):
    text = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def corpus(seed=7, n=120):
    """Texts with copies, near copies, a hot passage, empties, nulls, ties and a very long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 25))).capitalize()
    hot = line()
    texts = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(n)]
    for k in range(0, n, 3):
        base = texts[r.randrange(n)]
        words = base.split(" ")
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [hot + "\n" + t for t in texts[:40]] + [hot] * 5 + [None, "", " \n\t", "one", "one", "A b", "a B", "word " * 30_000]
    return [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)]


def test_quality_counts(spark):
    rows = [*corpus(), (9000, "a#b $x\na#b $x\n\n" + "w1 w2 w3 w4 w5 w6 w7 w8 " * 3, "en")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        words = split(t, False)
        windows = defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        covered = {j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (got[i].base_failed and got[i].kept)
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_quality_fences_follow_the_group(spark):
    r = random.Random(2)
    text = lambda: [str(r.getrandbits(20)).zfill(7) for _ in range(100)]
    rows = [(i, " ".join(text()), "en") for i in range(250)]
    again = text()
    again[50:60] = again[10:20]
    lines = [" ".join(text()[:7]) for _ in range(8)]
    rows += [(900, " ".join(again), "en"), (901, "\n".join([*lines, lines[0], lines[4]]), "en")]
    got = {x.doc_id: x for x in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert not any(got[i].base_failed or got[i].kept for i in (900, 901)) and all(got[i].kept for i in range(250))


def test_language(spark):
    r = random.Random(1)
    alphabet = {"xx": "abcde", "yy": "stuvw"}
    rows = [(i, " ".join("".join(r.choice(alphabet[lang]) for _ in range(4)) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx"), (901, "12 !", "yy"), (902, "", None), (903, "abcd " * 40_000, None), (904, "\U0001f600 é", None)]
    got = {x.doc_id: x for x in language_id.language_id(table(spark, rows), sample=50).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, lang in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    kept = language_id.reject(table(spark, rows), sample=50)
    assert kept.columns == table(spark, []).columns and {900, 901, 902}.isdisjoint(x.doc_id for x in kept.collect())
    assert language_id.language_id(table(spark, [])).count() == 0


def test_texts_far_from_every_language_are_rejected(spark):
    r = random.Random(6)
    common = {"en": "the of and to in is that it was for with his they this have from one had word but".split(), "de": "der die und das ist nicht ein eine ich sie mit auf dem zu den wir auch nach bei wird".split()}
    rows = [(i, " ".join(r.choice(common[lang]) for _ in range(80)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(900, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(80)), "en"), (901, "w przypadku gdy jest to mo\u017cliwe nale\u017cy si\u0119 zwr\u00f3ci\u0107 do s\u0105du kt\u00f3ry rozstrzyga " * 5, None)]
    kept = {x.doc_id for x in language_id.reject(table(spark, rows)).collect()}
    assert kept == set(range(120))


def test_token_blocks():
    r = np.random.default_rng(1)
    for ids in (np.array([7]), np.zeros(5000), r.integers(0, 50257, 8192), np.append(r.integers(0, 9, 100), 2**32 - 1), r.integers(0, 2**32, 999)):
        ids = ids.astype(np.uint32)
        assert (token_file.unpack(token_file.pack(ids)) == ids).all()
    out = io.BytesIO()
    writer = token_file.Writer(out)
    docs = [(i, r.integers(0, 50257, int(n)).astype(np.uint32)) for i, n in enumerate([0, 1, 20_000, 3, 0, 9000])]
    for i, ids in docs:
        writer.add([i], ids, np.array([len(ids)]))
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    back = [(i, ids.tolist()) for i, _, ids in token_file.Reader(Source(out.getvalue())).documents(step=5000)]
    assert back == [(i, ids.tolist()) for i, ids in docs]


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(), (8000, "日本 été 12's \t<|endoftext|> x", None), (8001, "a<|endoftext|>b", None), (None, "no id", None)]
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = token_file.token_ids(table(spark, rows).repartition(3), tokenizer_path("byte_bpe_50k.json")).collect()
    want, at = {}, 0
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    assert token_file.token_ids(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_signatures_are_few_and_shared():
    import numpy as np
    from grainmill.functions.signatures import Bands, signatures

    r, bands = np.random.default_rng(4), Bands(80)
    hot = r.integers(1, 2**63, 2, dtype=np.uint64)  # features that all sets share
    pairs = []
    for n in [*range(1, 60), 90, 200, 1000] * 3:
        base = np.concatenate((hot[: n // 2], r.integers(1, 2**63, n, dtype=np.uint64)))
        drop = int(len(base) * r.uniform(0, 0.2))  # what is left reaches 80 %
        pairs += [base, base[drop:]]
    size = np.array([len(x) for x in pairs])
    row, sign = signatures(np.repeat(np.arange(len(pairs)), size), np.concatenate(pairs), size, bands)
    first, last = bands.instances(size)
    most = np.array([sum(int(bands.k[j]) + 1 for j in range(a, b + 1) if bands.k[j]) for a, b in zip(first, last, strict=True)])
    assert (np.bincount(row, minlength=len(pairs)) <= most).all()
    own = [set(sign[row == k].tolist()) for k in range(len(pairs))]
    assert all(own[k] & own[k + 1] for k in range(0, len(pairs), 2) if size[k] != size[k + 1])


def brute_components(rows, words, percent):
    def features(t):
        w = split(t)
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = [(i, features(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_join(spark, words, percent):
    rows = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_join(table(spark, rows), words=words, percent=percent)[0].collect()}
    want = brute_components(rows, words, percent)
    assert got == want
    if words == 5:
        kept = partenum.keep_one(table(spark, rows), words=words, percent=percent)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == table(spark, []).columns
        assert partenum.keep_one(table(spark, [])).count() == 0 and partenum.keep_one(table(spark, [(1, "a b", None)] * 3)).count() == 1


def test_large_buckets_lose_no_link(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):  # a chain of near copies around one text, the ends of which aren't alike
        w = list(base)
        for k in r.sample(range(60), r.randint(0, 4)):
            w[k] = f"x{r.randint(0, 3)}"
        rows.append((i, " ".join(w), None))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.jaccard_join(table(spark, rows), words=2, percent=85)[0].collect()}
    assert got == brute_components(rows, 2, 85)


def test_a_hub_whose_copies_are_not_all_alike(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(base), None)]
    for i in range(1, 300):  # near copies with up to 16 words exchanged: some link, some miss the threshold closely
        w = list(base)
        for k in r.sample(range(80), r.randint(1, 16)):
            w[k] = f"x{r.randint(0, 30)}"
        rows.append((i, " ".join(w), None))
    want = brute_components(rows, 1, 80)
    for block, bits in ((4096, 64), (40, 5)):  # bits: hashes that different sets share
        monkeypatch.setattr(partenum, "BLOCK", block)
        got = partenum.jaccard_join(table(spark, rows), words=1, percent=80, bits=bits)[0].collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want, (block, bits)


def test_unlike_texts_of_one_doc_id_stay(spark):
    text, other = "one two three four five six seven", "quite another text that has nothing to do with it"
    kept = partenum.keep_one(table(spark, [(1, text, None), (2, text, None), (2, other, None), (2, other, None), (3, other, None)]))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(1, text), (2, other)]


def test_spanning_links_reach_all_that_is_near():
    r = np.random.default_rng(4)
    for m, width in ((1, 1), (30, 1), (30, 4), (80, 1)):
        part = r.integers(0, max(1, m // 2), m)
        part = np.unique(part, return_inverse=True)[1]
        near = r.random((m, m)) < 2 / m
        near = (near | near.T) & (part[:, None] != part)
        found = partenum._spanning(part, lambda i, among: near[i, among], width)

        def groups(edges):
            root = list(range(int(part.max()) + 1))
            for a, b in edges:
                x, y = root[part[a]], root[part[b]]
                root = [min(x, y) if k in (x, y) else k for k in root]
            return root

        assert all(near[i, j] for i, js in found for j in js)
        assert groups((i, j) for i, js in found for j in js) == groups(zip(*np.nonzero(near), strict=True))
        assert sum(len(js) for _, js in found) <= width * (part.max() + 1)


def brute_lines(rows, percent=80, least=5):
    seen, gone = [], defaultdict(list)
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            s = set(split(line))
            if len(s) < least:
                continue
            if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                gone[i].append(k)
            seen.append(s)
    return gone


@pytest.mark.parametrize(("small", "block"), [(2, 8192), (512, 6)])
def test_line_dedup(spark, monkeypatch, small, block):
    rows = corpus(11)
    gone = brute_lines(rows)
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    out = line_dedup.line_dedup(table(spark, random.Random(1).sample(rows, len(rows))), least=5)
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _ in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want))
    assert out.columns == table(spark, []).columns and len(got) == len(rows)
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_lines_that_only_a_later_candidate_matches(spark):
    r = random.Random(12)
    base = [f"w{k}" for k in range(300)]  # long lines, whose sketches rule nothing out
    texts = []
    for _ in range(60):
        w = list(base)
        for k in r.sample(range(300), r.randint(10, 45)):
            w[k] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(w))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    gone = brute_lines(rows, least=1)
    docs = table(spark, rows[::-1]).selectExpr("*", "1 _doc", "2 _row", "'a' _hash", "3 _removed")
    got = {x.doc_id: x for x in line_dedup.line_dedup(docs).collect()}
    assert 10 < len(gone) < 58 and all(got[i].text == ("" if gone[i] else t) and (got[i]._doc, got[i]._hash) == (1, "a") for i, t, _ in rows)


def test_one_exchange_finds_the_candidates(spark, monkeypatch):
    """Lines whose earliest candidates fail are settled without moving their cells again."""
    rounds, near = [], line_dedup._near
    monkeypatch.setattr(line_dedup, "WIDTH", 64, raising=False)
    monkeypatch.setattr(line_dedup, "_near", lambda percent, width: rounds.append(width) or near(percent, width))
    r = random.Random(12)
    texts = []
    for _ in range(60):
        w = [f"w{k}" for k in range(300)]
        for k in r.sample(range(300), r.randint(10, 45)):
            w[k] = f"x{r.randint(0, 99)}"
        texts.append(" ".join(w))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    gone = brute_lines(rows, least=1)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert len(rounds) == 1 and got == {i: "" if gone[i] else t for i, t, _ in rows}


def test_postings_travel_packed():
    """A posting of a short line takes 30 bytes at most, and all come back with their cells whole."""
    r = np.random.default_rng(1)
    n = 20_000
    for large, most in ((0, 30), (9, 60)):
        size = r.integers(1, 60, n) + large * r.integers(0, 30, n)
        wide = [np.where(size >= line_dedup.LONG, r.integers(-(1 << 62), 1 << 62, n), 0) for _ in range(3)]
        rows = [r.integers(0, 1 << 22, n), r.integers(0, 99, n), r.integers(-(1 << 62), 1 << 62, n), r.integers(-(1 << 62), 1 << 62, n), r.random(n) < 0.5, *wide]
        of = np.repeat(np.arange(n, dtype=np.int32), 7)
        cells = r.integers(0, 1 << 54, len(of)) << 8
        cells[::5] = cells[0]
        shape = (size[of] << 8) | r.integers(1, 8, len(of))
        batch = line_dedup._packed(rows, cells, shape, of, 13)
        assert sum(map(len, batch.column("block").to_pylist())) <= most * len(of) and batch.num_rows == 13
        got = list(line_dedup._cells(iter([batch]), 1000))
        assert sum(len(np.unique(p[0])) for p in got) == len(np.unique(cells))
        doc, place, c, sketch, open_, *wide = (x[of] for x in rows)
        want = np.stack([x.astype(np.int64) for x in (cells, doc, place, c, shape, sketch, open_, *wide)])
        back = np.stack([np.concatenate([p[k].astype(np.int64) for p in got]) for k in range(len(want))])
        assert (back[:, np.lexsort(back)] == want[:, np.lexsort(want)]).all()


def test_pairs_of_like_size_are_all_compared():
    """The pairs of a cell are those of a plain loop, whichever of the two is the longer one."""
    r = np.random.default_rng(2)
    n = 300
    size, doc = r.integers(1, 12, n), r.permutation(n)
    rows = [doc, np.zeros(n, np.int64), np.arange(n), r.integers(0, 4, n), r.random(n) < 0.7, *(np.zeros(n, np.int64) for _ in range(3))]
    cells = r.integers(0, 5, n) << 8
    batch = line_dedup._packed(rows, cells, (size << 8) | 1, np.arange(n, dtype=np.int32), 2)
    got = {(a, b) for x in line_dedup._near(80, 1000)(iter([batch])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
    one = [np.array([x]) for x in (1,)]
    want = {
        (a, b) for a in range(n) for b in range(n)
        if doc[a] < doc[b] and cells[a] == cells[b] and rows[4][b] and line_dedup._allowed(size[[b]], one[0], size[[a]], one[0], (rows[3][[a]] ^ rows[3][[b]]), 80)[0]
    }
    assert got == want and len(want) > 100


def test_a_task_gives_its_memory_back():
    """A worker that stays between tasks keeps little of what a task has freed."""
    code = """if True:
        import os
        import pyarrow as pa
        from grainmill.functions.batches import chunks
        def rss():
            return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20
        batch = pa.RecordBatch.from_pydict({"text": ["a"]})
        before = rss()
        def rows():
            held = [bytearray(50_000) for _ in range(4000)]
            keep.append(held[-1])
            del held
            yield batch
        keep = []
        list(chunks(rows()))
        print(rss() - before)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 60


def test_rare_words_are_counted_beyond_16_bits():
    batch = pa.RecordBatch.from_pydict({"text": ["often " * 70_000 + "twice twice once"]})
    counts = list(line_dedup._count(14)(iter([batch])))
    total = np.sort(np.concatenate([np.frombuffer(x, np.uint32 if w else np.uint16) for b in counts for w, x in zip(b.column("wide").to_pylist(), b.column("counts").to_pylist(), strict=True)]))
    assert total[-3:].tolist() == [1, 2, 70_000]
    levels = np.concatenate([np.frombuffer(x, np.uint8) for b in line_dedup._levels(iter(counts)) for x in b.column("levels").to_pylist()])
    assert sorted(levels[levels > 0].tolist()) == [1, 2, 2 + int(8 * np.log2(35_000))]


def test_registered_line_dedup_takes_short_lines(spark, tmp_path):
    from grainmill.llm import queries

    r = random.Random(4)
    short = ["\n".join(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 7))) for _ in range(3)) for _ in range(40)]
    rows = [*corpus(11), *((1000 + i, t, None) for i, t in enumerate(short)), (2000, "All rights reserved.\n\nmenu", None), (2001, "All rights reserved.\n\nhome\nMENU", None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    gone = brute_lines(rows, least=1)
    got = {x.doc_id: x.text for x in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t, _ in rows}
    assert got[2001] == "\nhome"


def test_decontamination(spark):
    item = "Mary Smith drove 120 km in 3 hours and then she walked another 5 km to reach the old town hall before noon"
    again = "yesterday Paula Jones drove 77 km in 9 hours and then she walked another 4 km to reach the old town hall before noon they say"
    mixed = "yesterday Paula Jones drove 77 km in 9 hours and then she walked another 77 km to reach"
    rows = [(1, "so " + item.upper() + " ok", None), (2, again, None), (3, "a clean text about drove and walked in the old town of some other place far away " * 3, None), (4, None, None), (5, "", None), (6, "x " * 50_000 + item, None)]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only eight words stand here in this item")], "item_id long, text string")
    got = {(r.doc_id, r.item): (r.n_windows > 0, r.verbatim > 0) for r in decontaminate.hits(table(spark, rows), items).collect()}
    assert got == {(1, 1): (True, True), (2, 1): (True, False), (6, 1): (True, True)}
    far = spark.createDataFrame([(1, "Mary Smith drove 120 km in 3 hours and then she walked another 5 km to reach")], "item_id long, text string")
    assert decontaminate.hits(table(spark, [(1, again, None)]), far, size=16).first().verbatim == 0
    assert decontaminate.hits(table(spark, [(1, mixed, None)]), far, size=16).count() == 0  # 77 stands for two values
    assert sorted(r.doc_id for r in decontaminate.clean(table(spark, rows), items).collect()) == [3, 4, 5]
    assert decontaminate.hits(table(spark, rows), items.limit(0)).count() == 0 and decontaminate.hits(table(spark, []), items).count() == 0


def test_short_items_count_verbatim(spark):
    items = spark.createDataFrame([(1, "What is Two plus two?"), (2, "Who saw 7 cats"), (3, "?")], "item_id long, text string")
    texts = ["so what is two plus two ok", "what is three plus two", "he asked: who saw 7 cats?", "who saw 8 cats", "?", "Who saw 7 Dogs"]
    got = decontaminate.hits(table(spark, [(i, t, None) for i, t in enumerate(texts)]), items).collect()
    assert sorted((r.doc_id, r.item, r.verbatim > 0) for r in got) == [(0, 1, True), (2, 2, True)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def brute_spans(t):
    s = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if valid(kind, m[0]))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in s)


def test_personal_data(spark):
    r = random.Random(5)
    parts = ["a@b.c", "x.y_z@d-e.f.g", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (867) 555-2364", "+44 20 79460958", "@", ".", "é", "😀", " ", "-", "5", "00012.1.2.3", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "x" * 60_000, "1 " * 4000, "a.b@c.d " * 2000, "+" + "1" * 5000]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in pii.personal_data(table(spark, rows)).collect()}
    assert all(got[i].base_spans == brute_spans(t) for i, t, _ in rows) and len(got) == len(rows)
    assert all(got[i].n_email == brute_spans(t).count("email") for i, t, _ in rows)
    assert pii.personal_data(table(spark, [])).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"some words then call phone: +1 867 555 {1000 + i} thanks and bye", None) for i in range(12)]
    rows += [(100, "more words then call phone: 867-555-4242 thanks and bye", None), (101, "order number 867-555-4243 was sent", None), (102, "this one may call phone: ok12 thanks", None)]
    got = {x.doc_id: x for x in pii.personal_data(table(spark, rows)).collect()}
    assert got[100].spans == "phone:28:40" and got[100].base_spans == "" and got[100].n_found == 1
    assert got[101].spans == got[102].spans == "" and all(got[i].spans == got[i].base_spans != "" for i in range(12))


def test_every_occurrence_of_an_accepted_identifier(spark):
    rows = [(i, f"some words then call phone: +1 867 555 {1000 + i} thanks and bye", None) for i in range(12)]
    rows += [(100, "more words then call phone: 867-555-4242 thanks and bye", None), (101, "more words then call phone: 555 123 4567 thanks and bye", None)]
    rows += [(110, "867-555-4242 opens", None), (111, "x 867-555-4242", None), (112, "867-555-4241 or 867-555-4242, 867-555-4242", None)]
    rows += [(120, "555 123 4567", None), (121, "7 555 123 4567 8", None), (122, "a 555 123 4568 and 1 555  123 4567.", None), (123, "1 " * 500 + "555 123 4567", None)]
    got = {x.doc_id: x.spans for x in pii.personal_data(table(spark, rows)).collect() if x.doc_id >= 100}
    assert got == {
        100: "phone:28:40", 101: "phone:28:40", 110: "phone:0:12", 111: "phone:2:14", 112: "phone:16:29,phone:30:42",
        120: "phone:0:12", 121: "phone:2:14", 122: "phone:21:35", 123: "phone:1000:1012",
    }


def luhn(head):
    return next(head + c for c in "0123456789" if valid("card", head + c))


def test_forms_discover_what_a_base_match_swallowed(spark):
    r = random.Random(8)
    cards = [luhn("".join(r.choice("123456789") for _ in range(15))) for _ in range(44)]
    phones = [f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}" for _ in range(42)]
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    rows = [(i, f"{word()} {word()} {x} {word()}", None) for i, x in enumerate(cards[:40] + phones[:40])]
    bad = cards[40][:-1] + str((int(cards[40][-1]) + 1) % 10)
    rows += [(100, f"x {cards[41]} {cards[42]} y", None), (101, f"{phones[40]} 10.20.30.40", None), (102, f"a {bad} b", None), (103, f"order {cards[43][:12]} z", None)]
    got = {x.doc_id: x for x in pii.personal_data(table(spark, rows)).collect()}
    assert got[100].base_spans == "" and got[100].spans == "card:2:18,card:19:35"
    assert got[101].base_spans == "ip:18:29" and got[101].spans == "phone:0:17,ip:18:29"
    assert got[102].spans == got[103].spans == "" and sum(x.n_found for x in got.values()) == 3


def test_long_texts_take_time_in_proportion(spark):
    import time

    def took(n):
        texts = ["a@b.c " * n, "7" + "-" * n + "x", "1.2.3.4 " * n, "+1 " * n, "word " * n, "4111 1111 1111 1111, " * (n // 4), "1 " * n]
        rows = [(i, t, None) for i, t in enumerate(texts)]
        began = time.time()
        assert pii.personal_data(table(spark, rows)).count() == len(rows)
        return time.time() - began

    took(10)
    assert took(40_000) < 90


def test_rounds_go_on_while_they_accept(spark):
    rows = [(i, f"x alpha one +1 867 {100_0000 + i} end", None) for i in range(1000)]
    for k, n in enumerate((100, 10, 1)):  # what a step's pattern accepts makes the next one trusted
        for step in ("alpha one", "beta two", "gamma three")[k : k + 2]:
            rows += [(len(rows) + i, f"x {step} {k}67-555-{2000 + i} end{len(rows)}", None) for i in range(n)]
    got = [x for x in pii.personal_data(table(spark, rows)).collect() if x.doc_id >= 1000]
    assert len(got) == 221 and all(x.n_found == 1 for x in got)


def test_sentence_pieces(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*corpus(), (7000, "  a  b\n c é😀 日本 <s> <0x0A>", None), (7001, "▁a", None), (7002, "aaaaaaaaa" * 3000, None)]
    got = {r.doc_id: r for r in sentence_piece.encode(table(spark, rows), path).collect()}
    assert all(got[i].piece_ids == library.encode(t or "") and got[i].round_trip == (i != 7001) for i, t, _ in rows)
    back = {r.doc_id: r.text for r in sentence_piece.decode(sentence_piece.encode(table(spark, rows), path), path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, _ in rows)
    assert sentence_piece.encode(table(spark, []), path).count() == 0


def test_registered_pieces_come_with_ids(spark, tmp_path):
    import sentencepiece

    from grainmill.llm import queries

    table(spark, [(1, "some words", None), (2, None, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.piece_ids for r in queries.op6_sentence_piece(spark, str(tmp_path)).collect()}
    assert got == {1: library.encode("some words"), 2: []}


def test_unigram_viterbi():
    r = random.Random(2)
    pieces = [("<unk>", 0.0, 2), *{"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))): None for _ in range(60)}]
    pieces = [pieces[0], *((p, -r.random() * 9, 1) for p in pieces[1:] if "▁" not in p.lstrip("▁"))]
    model = sentence_piece.PieceModel(pieces=pieces, unigram=True)

    def best(word):
        score = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            options = [score[s] + model.scores[word[s:end]] for s in range(end) if word[s:end] in model.scores] + [score[end - 1] + model.unknown_score]
            score[end] = max(options)
        return score[-1]

    words = ["▁" + "".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(200)]
    for word, own in model.walk(list(set(words))):
        assert "".join(own) == word and abs(sum(model.scores.get(p, model.unknown_score) for p in own) - best(word)) < 1e-9


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.com/en/7x?q", "https://x.com/en/8#f", "https://example.net/de/81", "https://example.net/de/9", "http://a.org/es/", "http://notcom/en/",
        "http://m.cheap-pills.example.com/x", "http://cheap-pills.example.net/de/1", "http://fine.example.com/", "http://org?x", "ftp://h/" + "p" * 50_000, "http://É.com/en/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = [(r.host[:20], r.path[:8], r.rule, r.verdict) for r in url_filter.url_filter(pages, URL_RULES, URL_BLOCKED).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("x.com", "/en/8", "com/en/", "block"),
        ("example.net", "/de/81", "example.net/de/8", "block"), ("example.net", "/de/9", "net/de/", "allow"), ("a.org", "/es/", "org/es/", "block"), ("notcom", "/en/", None, "allow"),
        ("m.cheap-pills.exampl", "/x", None, "block"), ("cheap-pills.example.", "/de/1", "net/de/", "allow"), ("fine.example.com", "/", None, "allow"), ("org", "", None, "allow"), ("h", "/ppppppp", None, "allow"),
        ("É.com", "/en/", "com/en/", "block"),
    ]
    assert url_filter.url_filter(pages.limit(0), URL_RULES, URL_BLOCKED).count() == 0


def test_hosts_of_many_labels_take_memory_in_proportion():
    import tracemalloc

    index = url_filter.DigestIndex(url_filter.build([("a.com", "", 2), ("com", "/x", 0), ("b.a.com", "/y", 1)]))
    url = "http://" + "l." * 50_000 + "b.a.com/y"
    tracemalloc.start()
    assert index.judge([url, "http://..a.com./x", "http://a.com", "http://.com/x", "http://com/xy"]) == [
        ("l." * 50_000 + "b.a.com", "/y", "b.a.com/y", "allow"), ("..a.com.", "/x", None, "allow"), ("a.com", "", None, "block"), (".com", "/x", "com/x", "block"), ("com", "/xy", "com/x", "block"),
    ]
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_colliding_digests_decide_nothing():
    weak = lambda s: len(s) % 3
    index = url_filter.DigestIndex(url_filter.build([("a.com", "", 2), ("b.org", "", 2), ("net", "/x", 0)], weak), weak)
    assert [v for *_, v in index.judge(["http://a.com/", "http://c.com/", "http://w.b.org/q", "http://q.net/xy", "http://q.net/y"])] == ["block", "allow", "block", "block", "allow"]


def test_web_archives(spark):
    bodies = ["<p>é</p>", "same", "same", None, "", "big " * 100_000, "same", "x\r\n\r\ny"]
    pages = spark.createDataFrame([(i, "http://h/ \n" if i else None, b, "k") for i, b in enumerate(bodies)], "page_id long, url string, html string, keeper string")
    folder, parts = warc.write_archives(pages.repartition(3))
    got = {r.page_id: r for r in warc.read_archives(spark, folder, parts).collect()}
    for i, b in enumerate(bodies):
        raw = (b or "").encode()
        keeper = max(k for k, x in enumerate(bodies) if (x or "") == (b or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == keeper else ("revisit", keeper))
    assert {r.record_type for r in warc.warc(pages, least_bytes=5).filter("page_id in (1, 2, 6)").collect()} == {"response"}
    assert warc.warc(pages.limit(0)).count() == 0
    fs, path = warc.open_fs(folder)
    with fs.open_input_file(f"{path}/part-{parts[0]:06d}.wacz") as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]


def test_plain_zip_files_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a PK\5\6 comment"
        z.writestr("a/ü.txt", "hello")
        z.writestr("b.bin", b"x" * 100)

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    package = warc.Package(Source(out.getvalue()))
    at, size = package.place("a/ü.txt")
    assert package.range(at, size) == b"hello" and package.place("b.bin")[1] == 100
