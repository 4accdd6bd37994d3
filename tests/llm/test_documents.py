"""Operators on documents against brute force, with the awkward rows that any column may hold."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprints, language_id, near_dedup, packing, suffix_dedup, toxicity
from tidemark.llm.queries import tokenizer_file, tokenizer_pattern

WORDS = "the sun rises over old harbour while boats wait for wind and gulls circle above quiet water until evening falls again".split()
PASSAGE = "every copy of this licence passage is repeated word for word in several of the documents below"


def _texts():
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    base = say(120)
    rows = [(1, base), (2, base), (3, base + " indeed"), (4, say(90)), (5, say(40) + " " + PASSAGE + " " + say(30)), (6, PASSAGE + " " + say(20))]
    rows += [(7, None), (8, ""), (9, "   \n\t "), (10, "one"), (11, "two words"), (12, "aaaa" * 40), (13, "aaaa" * 30), (14, say(12_000)), (15, "ÄÖÜ ñ 你好 " * 20)]
    rows += [(16, "Ещё один ДОКУМЕНТ"), (17, say(60) + " " + PASSAGE.upper()), (None, base), (None, None), (4, say(55)), (18, base), (18, base), (-5, "negative " + PASSAGE)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{k % 3}", 1, 7, "x") for k, (i, t) in enumerate(_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, g int, bits string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def _simhash(terms):
    total, ones = 0, [0] * 64
    for a, b in terms:
        length = len(a) + (len(b) + 1 if b is not None else 0)
        weight = 1 if length <= 7 else 2 if length <= 12 else 3
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        total += weight
        for bit in range(64):
            ones[bit] += weight * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > total)


def _fingerprint(text):
    words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text.lower()) if w]
    return _simhash(list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(w, None) for w in words])


def test_fingerprints_match_brute_force(docs):
    rows = fingerprints.compare_documents(docs).collect()
    texts = [(i, t or "") for i, t in _texts()]
    assert len(rows) == len(texts)
    keys = sorted({-(1 << 63) if i is None else i for i, _ in texts}, reverse=True)
    after = dict(zip(keys, keys[1:] + keys[:1], strict=True))
    by_key = {}
    for i, t in texts:
        by_key.setdefault(-(1 << 63) if i is None else i, []).append(t)
    most = {k: max(len(t) for t in v) // 3 for k, v in by_key.items()}
    expected = []
    prints = {_fingerprint(t) for _, t in texts}
    for i, t in texts:
        key = -(1 << 63) if i is None else i
        starts = [(x[: most[key]].encode(), _signed(xxhash.xxh64_intdigest(x.encode(), 42)), x) for x in by_key[after[key]]]
        follow = min(starts)[2]
        third = len(t) // 3
        edited = t[: len(t) - third] + follow[: most[key]][:third]
        a, b, c = _fingerprint(t), _fingerprint(edited), _fingerprint(follow)
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64, sum(0 < (a ^ x).bit_count() <= 3 for x in prints)))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_nothing(empty, spark):
    assert fingerprints.compare_documents(empty).collect() == []
    one = fingerprints.compare_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0


def test_hot_ids_and_seams_match_plain_fingerprints(spark, monkeypatch):
    """Rows of one doc_id over several tasks give the same result, and so do texts that are cut at any place of a word."""
    rng = np.random.default_rng(11)
    rows = [(7, " ".join(rng.choice(WORDS, int(rng.integers(1, 9))))) for _ in range(60)] + [(None, "hot"), (None, "hot")] * 9
    rows += [(i, t) for i, t in enumerate(["", " ", "a", " a", "a ", "ab cd", "ab  cd\tef", "abc", " x y z ", "ΑΣ ΒΣ ΓΣ", "İx İy İz", "\u00a0one two", "one two three four five six "], 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = sorted(map(tuple, fingerprints.compare_documents(frame).collect()), key=repr)
    monkeypatch.setattr(fingerprints, "HOT_ROWS", 5)
    assert sorted(map(tuple, fingerprints.compare_documents(frame).collect()), key=repr) == plain and len(plain) == len(rows)
    texts = spark.createDataFrame([(i, t, cut, s) for i, (_, t) in enumerate(rows) for cut in range(0, len(t) + 1, 3) for s in ("", "new", " new words")], "id int, text string, cut int, start string").withColumn("row", F.monotonically_increasing_id())
    texts = spark.createDataFrame(texts.collect(), texts.schema)
    whole = texts.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("cut")), F.col("start")))
    got = {r.row: (r.bits, r.edited_bits) for r in fingerprints.fingerprint_pairs(texts, ["row"], []).collect()}
    own = {r.row: r.bits for r in fingerprints.fingerprints(whole, ["row"]).collect()}
    edited = {r.row: r.bits for r in fingerprints.fingerprints(whole, ["row"], "edited").collect()}
    assert got == {k: (own[k], edited[k]) for k in own}


@pytest.mark.parametrize("crowded", [4096, 3])
def test_block_tables_find_all_near_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(fingerprints, "CROWDED", crowded)
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63, 40)
    values = {int(x) for x in base}
    for x in base[:15]:
        for flips in range(1, 6):
            y = int(x) & (2**64 - 1)
            for bit in rng.choice(64, flips, replace=False):
                y ^= 1 << int(bit)
            values.add(_signed(y))
    frame = spark.createDataFrame([(v,) for v in [*values, *values, None]], "bits long")
    got = {tuple(r) for r in fingerprints.near_fingerprints(frame).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_next_keys_over_wide_gaps(spark):
    keys = [-(2**63), -7, 0, 1, 5000, 2**30, 2**45 + 1, 2**45 + 2, 2**62, 2**63 - 1]
    got = {r.key: r.next_key for r in fingerprints.next_keys(spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    down = sorted(keys, reverse=True)
    assert got == dict(zip(down, down[1:] + down[:1], strict=True))


def test_near_duplicates_match_brute_force(docs, empty):
    def bits(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    rows = [(i, bits(t)) for i, t in _texts()]
    group = list(range(len(rows)))
    for _ in rows:
        for x, (_, a) in enumerate(rows):
            for y, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3:
                    group[x] = group[y] = min(group[x], group[y])
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in set(group)}
    expected = [(i, f"{b:016x}", least[g]) for (i, b), g in zip(rows, group, strict=True)]
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect()), key=repr) == sorted(expected, key=repr)
    assert near_dedup.near_duplicates(empty).collect() == []


def _classes(values):
    """The smallest position that steps of three bits or fewer lead to, for each value, by brute force."""
    root = list(range(len(values)))
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    moved = True
    while moved:
        moved = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                moved = True
    return root


def test_bucket_links_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for bits, n in ((14, 120), (20, 150), (30, 60)):
        nodes = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64))
        for pairs in (1 << 19, 64):
            monkeypatch.setattr(near_dedup, "BLOCK_PAIRS", pairs)
            assert near_dedup.bucket_links(nodes).tolist() == _classes(nodes.tolist())


@pytest.mark.parametrize("crowded", [8192, 4])
def test_covering_links_of_crowded_buckets(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(6):  # families that share most of their tables' keys
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(40):
            value = centre
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                value ^= 1 << int(bit)
            values.add(value)
    ordered = sorted(values)
    frame = spark.createDataFrame([(_signed(v),) for v in ordered], "bits long")
    named = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in near_dedup.connected_components(near_dedup.covering_links(frame)).collect()}
    classes = {}
    for v, root in zip(ordered, _classes(ordered), strict=True):
        classes.setdefault(root, []).append(v)
    for own in classes.values():
        assert len({named.get(v, v) for v in own}) == 1
    assert len({named.get(v, v) for v in ordered}) == len(classes) < len(ordered)


def test_repeats_match_brute_force(docs, empty):
    rows = [(i, (t or "").encode()) for i, t in _texts()]
    order = lambda i: (1 << 62) if i is None else i
    seen = {}
    for i, b in sorted(rows, key=lambda r: order(r[0])):
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], order(i))
    expected = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    got = suffix_dedup.remove_repeats(docs, ("bits", "g"))
    assert got.columns[-2:] == ["bits", "g"]
    assert sorted([tuple(r)[:5] + (bytes(r.remaining),) for r in got.collect()], key=repr) == sorted(expected, key=repr)
    assert any(r[2] for r in expected) and suffix_dedup.remove_repeats(empty).collect() == []


def test_remaining_characters_are_whole_and_marks_of_the_input_stay(spark):
    passage = "d\u00e9j\u00e0 vu \u2014 every copy of this passage is repeated word for word \u20ac"
    rows = [(1, "\u00e9" + passage + "\u00e9"), (2, "caf\ufffd kept? \u00e8" + passage + "\u00e8 \ufffd tail"), (3, "\ufffd alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.remaining).decode() for r in suffix_dedup.remove_repeats(frame, whole_characters=True).collect()}
    # The bytes of e-acute and e-grave begin alike, so the repeat ends within a character; what is left of it goes too.
    assert got == {1: rows[0][1], 2: "caf\ufffd kept? \u00e8 \ufffd tail", 3: "\ufffd alone"}


def test_touched_characters_match_a_look_at_each():
    rng = np.random.default_rng(3)
    text = "aé€😀" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    for share in (0.02, 0.2, 0.9):
        gone = rng.random(len(data)) < share
        expected, at = [], 0
        for c in text:
            n = len(c.encode())
            expected += [bool(gone[at : at + n].any())] * n
            at += n
        assert suffix_dedup.touched_characters(data, gone).tolist() == expected


def test_large_anchor_groups_fall_back_to_offsets(monkeypatch):
    rng = np.random.default_rng(2)
    n = 60
    content = rng.integers(97, 99, (n, suffix_dedup.REGION)).astype(np.uint8)
    content[:, suffix_dedup.REACH : -suffix_dedup.REACH] = 120
    content[:, :14] = 97
    left, right = rng.integers(0, 19, n), rng.integers(0, 19, n)
    keys = rng.integers(0, 20, n)
    merged = suffix_dedup.repeated_windows(content, left, right, keys)
    monkeypatch.setattr(suffix_dedup, "MOST_STRINGS", 5)
    # Windows at an end that is cut off may only be compared where they are whole; both ways agree on all of them.
    shifted = np.zeros_like(content)
    for i in range(n):
        span = content[i, suffix_dedup.REACH - left[i] : suffix_dedup.REACH + suffix_dedup.ANCHOR + right[i]]
        shifted[i, suffix_dedup.REACH - left[i] : suffix_dedup.REACH - left[i] + len(span)] = span
    assert (suffix_dedup.repeated_windows(shifted, left, right, keys) == merged).all()


def test_packing_covers_all_tokens_without_padding(docs, empty):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern()).collect()
    by_doc, by_sequence, expected = {}, {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in _texts():  # rows that repeat a doc_id are packed each
        expected.setdefault(i, []).append(np.array(reference.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        lengths = sorted(len(ids) for ids in expected[i])
        assert sum(p.length for p in own) == sum(lengths) and {p.doc_tokens for p in own} == set(lengths)
        for p in own:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in expected[i])
        for n in set(lengths):  # every token of each row lies in exactly one piece
            times = np.zeros(n, dtype=int)
            for p in own:
                if p.doc_tokens == n:
                    times[p.start : p.start + p.length] += 1
            assert (times == lengths.count(n)).all()
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist()
        total = sum(p.length for p in own)
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack_documents(empty, tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern()).collect() == []


def test_sum_of_squares_prefers_the_level_with_the_least_change():
    packer = packing.SumOfSquares(10, 0)
    for doc, n in enumerate((6, 6, 4)):  # 6 + 6 gives two windows at level 6; 4 fills one of them
        packer.add(doc, np.arange(n, dtype=np.uint32))
    assert packer.counts[6] == 1 and packer.open == 1
    packer.finish()
    assert sum(r[2] for r in packer.rows) == 16


def _change(counts, size, n, level, cut):
    """The sum of squares after the choice, by counting windows one by one."""
    windows = [h for h, c in enumerate(counts) for _ in range(c)]
    if level:
        windows.remove(level)
    total = level + n
    windows += [total] if total <= size else [size, total - size]
    return sum(windows.count(h) ** 2 for h in range(1, size))


@pytest.mark.parametrize("cut", [False, True])
def test_levels_have_the_least_sum_of_squares_in_any_state(cut):
    rng = np.random.default_rng(12)
    for _ in range(600):
        size = int(rng.integers(2, 14))
        packer = packing.SumOfSquares(size, 0)
        packer.counts[1:size] = rng.integers(0, 4, size - 1) * (rng.random(size - 1) < 0.6)
        packer.open = int(packer.counts.sum())
        n = int(rng.integers(1, size))
        choices = [h for h in range(1, size) if packer.counts[h] and (cut or h + n <= size)] + ([0] if not cut or not packer.open else [])
        sums = {h: _change(packer.counts.tolist(), size, n, h, cut) for h in choices}
        level = packer.best_level(n, cut)
        assert level in choices and sums[level] == min(sums.values()), (size, packer.counts, n, sums, level)


def test_packing_closes_windows_by_the_rule(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 3)
    packer = packing.SumOfSquares(64, 0)
    rng = np.random.default_rng(2)
    lengths = rng.integers(33, 63, 200).tolist()  # no two fit into one window
    for doc, n in enumerate(lengths):
        packer.add(doc, np.arange(n, dtype=np.uint32))
        assert packer.open <= 3
    packer.finish()
    sizes = {}
    for doc, start, length, _, total, sequence, offset in packer.rows:
        assert offset == sizes.get(sequence, 0)
        sizes[sequence] = offset + length
    assert sum(sizes.values()) == sum(lengths) and all(n == 64 or n & (n - 1) == 0 for n in sizes.values()) and sum(n < 64 for n in sizes.values()) <= 6


def test_token_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    reference, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.TokenEncoder(tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern())
    for text in ["", " ", "a  b\n\n c\t", "it's 'll don'T", "naïve café ßẞ", "1234,5 €", "<|endoftext|> inside <|endoftext|>", "  x", "日本語 テキスト", "😀👩‍👩‍👧", "\x00\x01", "aaaa" * 100, "x" * 3000]:
        assert own.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_bpe_equals_tiktoken_and_decodes(docs, empty):
    import tiktoken

    ranks = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.parse_ranks(ranks))}, special_tokens={})
    rows = bpe.encode_documents(docs, ranks, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(_texts())
    expected = []
    for i, t in _texts():
        ids = np.array(reference.encode_ordinary(t or ""), dtype="<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted([tuple(r)[:4] for r in rows], key=repr) == sorted(expected, key=repr)
    assert bpe.encode_documents(empty, ranks, P.PATTERN).collect() == []
    vocabulary = bpe.vocabulary(ranks, P.PATTERN)
    for text in ["'s 't", "\n\n  \n x", "zzzzqqqq" * 50, "ﬁ ligature", "नमस्ते दुनिया", "a" * 999, " <|endoftext|>"]:
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_memo_is_bounded_in_bytes_within_one_text(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 4000)
    vocabulary = bpe.Vocabulary([bytes([i]) for i in range(256)], P.PATTERN)
    text = " ".join(f"word{i}" for i in range(500)) + "x" * 9000
    assert vocabulary.decode(vocabulary.encode(text)) == text.encode() and vocabulary.memo.held <= 4000
    assert vocabulary.memo.held == sum(bpe.ENTRY_BYTES + 4 * len(k) + len(v) for k, v in vocabulary.memo.items())


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(1000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(1000)) and [table.slot(k) for k in keys] == table.slot_of
    assert bpe.PerfectHash([b"a"]).slot(b"a") == 0


def test_language_on_awkward_rows(docs, empty, spark):
    rows = {(r.doc_id, r.lang_pred) for r in language_id.judge_language(docs).collect()}
    assert {(7, "und"), (8, "und"), (9, "und"), (1, "en"), (16, "en")} <= rows
    assert language_id.judge_language(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.judge_language(unlabelled).collect()] == ["und"]


def test_language_accuracy_on_held_out_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.judge_language(table).filter("held_out").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)


def _junk(n):
    """Texts of n characters or a little less in no language that the documents have."""
    rng = np.random.default_rng(n)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    other = ["Η γρήγορη αλεπού πηδάει πάνω από το σκυλί και τρέχει. ", "यह एक वाक्य है जो परीक्षण के लिए लिखा गया है। ", "สวัสดีชาวโลกนี่คือข้อความ", "Wczoraj wieczorem poszliśmy do kina, ale film nie był zbyt dobry. "]
    return [base64.b64encode(rng.bytes(n * 3 // 4)).decode(), letters, re.sub("[aeiou]", " ", letters), rng.bytes(n // 2).hex(), "zzzz" * (n // 4), *[(t * n)[:n] for t in other]]


def test_language_rejects_junk_and_keeps_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    model = language_id.fit(table, lambda doc_id: ~language_id.held_out(doc_id))
    for n in (300, 1000, 4000, 16000):
        assert all(rejected for _, _, rejected in model.predict(_junk(n))), n
    clean = [r.text for r in table.filter(language_id.held_out(F.col("doc_id"))).collect() if language_id.has_letter(r.text)]
    assert len(clean) > 200 and sum(rejected for _, _, rejected in model.predict(clean)) <= 0.01 * len(clean)
    # One odd training document, or a few in a hundred, do not loosen the floor.
    odd = spark.createDataFrame([(3 * 10**9 + i, t, "en") for i, t in enumerate(_junk(1000) + _junk(900))], table.schema)
    model = language_id.fit(table.unionByName(odd))
    assert all(rejected for t in _junk(4000)[:4] for _, _, rejected in model.predict([t]))


def _ngrams(text, sizes, bits):
    """Hashes of the character n-grams of a text, one by one."""
    letters = re.sub(rb"[^a-zA-Z\x80-\xff]+", b" ", (text or "").lower().encode()).strip()
    data = b" " + letters + b" "
    out = []
    for n in sizes:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
            out.append(((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits)
    return out


def test_language_and_score_match_brute_force(docs, spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(known)
    texts = [t for _, t in _texts()[:13]] + ["Straße, Füße und Äpfel", "où êtes-vous? 42!"]
    for text, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        if not language_id.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        counts = np.zeros(1 << language_id.BITS)
        for h in _ngrams(text, language_id.SIZES, language_id.BITS):
            counts[h] += h > 0
        vector = np.log1p(counts) * model.idf
        cosines = {}
        for name, centroid in zip(model.languages, model.centroids, strict=True):
            cosines[name] = max(cosines.get(name, 0.0), float(vector @ centroid / np.linalg.norm(vector)))
        assert np.isclose(score, max(cosines.values()), atol=1e-4) and cosines[lang] >= max(cosines.values()) - 1e-4


def test_toxicity_scores_match_brute_force(spark):
    rows = [(i, f"{WORDS[i % 17]} {WORDS[i % 5]} " + ("vile scoundrel" if i % 3 == 0 else "kind friend"), i % 3 == 0) for i in range(90)]
    table, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    grams = [set(_ngrams(t, toxicity.SIZES, toxicity.BITS)) - {0} for _, t, _ in rows]
    for h in np.flatnonzero(model.feature_of >= 0).tolist():  # each feature is in more than one document
        assert sum(h in g for g in grams) > 1
    texts = [t for _, t, _ in rows[:10]] + [None, "", "vile vile vile", "x"]
    for text, score in zip(texts, model.scores(texts), strict=True):
        z = model.bias + sum(model.weights[model.feature_of[h]] for h in set(_ngrams(text, toxicity.SIZES, toxicity.BITS)) if h and model.feature_of[h] >= 0)
        assert np.isclose(score, 1 / (1 + np.exp(-z)))


def test_toxicity_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS, 12)) + (" vile scoundrel" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    table, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    models = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for partitions in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            models.append(toxicity.fit(table, labels))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one, many = models
    assert (one.feature_of >= 0).any() and (one.feature_of == many.feature_of).all() and np.allclose(one.weights, many.weights) and np.isclose(one.bias, many.bias)


def test_toxicity_learns_words_and_survives_gaps(docs, empty, spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + (" vile scoundrel" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    got = toxicity.judge_toxicity(table, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == 242 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth) >= 0.97 * sum(r.held_out and r.doc_id in truth for r in got)
    assert len(toxicity.judge_toxicity(docs, labels.limit(0)).collect()) == len(_texts())
    assert toxicity.judge_toxicity(empty, labels).collect() == []
