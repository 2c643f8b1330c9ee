"""Methods by themselves: choices of the packing, the graph's recall, bounded memories, lanes of the piece search, name clashes."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from lexatlas.llm import id_files, near_dedup, packing, part_codes, pii_scan, secret_scan, sentence_pieces, suffix_dedup, textkernel, word_encoder  # noqa: E402


def plain_packing(lengths, capacity):
    """The rule by brute force: try every open sequence and a new one, count all squares again, take the least; ties as the operator breaks them."""
    gaps, out = [], []
    for size in lengths:

        def cost(where):
            after = list(gaps)
            if where == len(after):
                after.append(capacity)
            after[where] -= size
            counts = {}
            for g in after:
                if 0 < g < capacity:
                    counts[g] = counts.get(g, 0) + 1
            return sum(c * c for c in counts.values())

        fits = [w for w in range(len(gaps)) if size <= gaps[w] < capacity]
        best = min([cost(w) for w in fits] + [cost(len(gaps))])
        tied = [w for w in fits if cost(w) == best]
        # among equals an open sequence before a new one, of the smallest gap, the one that got it last
        least = min((gaps[w] for w in tied), default=None)
        out.append((best, least))
        where = tied[-1] if tied else len(gaps)
        if tied:
            where = [w for w in tied if gaps[w] == least][-1]
        else:
            gaps.append(capacity)
        gaps[where] -= size
    return out


def test_each_piece_goes_where_the_squares_are_least():
    for seed in range(6):
        lengths = np.random.default_rng(seed).integers(1, 13, 60)
        number = packing.sum_of_squares(lengths, 12)
        want = plain_packing(lengths.tolist(), 12)
        load, got = {}, []
        for size, where in zip(lengths.tolist(), number.tolist()):
            before = load.get(where, 0)
            load[where] = before + size
            counts = {}
            for filled in load.values():
                if 0 < 12 - filled:
                    counts[12 - filled] = counts.get(12 - filled, 0) + 1
            got.append((sum(c * c for c in counts.values()), 12 - before if before else None))
        assert got == want


def test_contexts_discover_identifiers_of_unseen_shapes(spark):
    """Three phrases with ten seeds each; unseen codes under the same phrases, alone, in rows and over line ends; numbers in prose are none."""
    rng = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"]
    words = [w.translate({ord(c): None for c in "0123456789"}) for w in words]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    seeds = ["4111111111111111", "5500005555555559", "4012888888881881", "10.1.2.3", "a@b.com", "+1 (415) 555-0101", "8.8.8.8", "c@d.org", "4000 0000 0000 0002", "e@f.net"]
    phrases = ["member number", "the\nclient  code:", "Reference no"]
    rows, true = [], set()
    for phrase in phrases:
        for s in seeds:
            rows.append((len(rows), f"{prose(8)} {phrase} {s}, {prose(5)}"))
        for k in range(40):
            code = f"{rng.choice('ABCDE')}{rng.randrange(10**5, 10**8)}-{rng.randrange(10, 99)}"
            true.add(len(rows))
            rows.append((len(rows), f"{prose(8)} {phrase} {code} {prose(5)}"))
    for k in range(300):
        rows.append((len(rows), f"{prose(8)} in {rng.randrange(1900, 2030)} {prose(3)} {rng.choice(words)} {rng.randrange(10**5, 10**8)} {prose(4)}"))
    found = pii_scan.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in found if any(s.kind == "context" for s in r.spans)}
    assert len(hit & true) >= 0.9 * len(true) and len(hit - true) <= 0.02 * len(rows), (len(hit & true), len(hit - true))
    for r in found:
        for s in r.spans:
            assert s.kind != "context" or r.text[s.start : s.end][0] in "ABCDE0123456789"


def test_contexts_overlap_and_reach_over_lines(spark):
    text = "id A1 B2\nC33333 end"
    got = spark.createDataFrame([(text,)], "t string").select(pii_scan.contexts(F.col("t"), F.lit(3))).first()[0]
    assert got == [["^ id _", "id _", "id _ #"], ["id # _", "# _", "# _ #"], ["# # _", "# _", "# _ end"]]


def test_scans_and_stages_survive_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh99 a@b.com", "x", 1, "y", [1], "z"), (2, None, "x", 2, None, None, None)], "doc_id long, text string, base string, spans int, _row string, _given array<int>, token string")
    for find, redact, mark in ((secret_scan.find_secrets, secret_scan.redact_secrets, "[SECRET]"), (pii_scan.find_pii, pii_scan.redact_pii, "[PII]")):
        found = {r.doc_id: r for r in find(docs).collect()}
        assert found[1]._row == "y" and found[1]._given == [1] and len(found[1].base) == 1 and found[2].spans == []
        clean = {r.doc_id: r for r in redact(docs).collect()}
        assert redact(docs).columns == docs.columns and mark in clean[1].text and clean[1].base == "x" and clean[1].spans == 1 and clean[2].text is None
    pieces = packing.pack_documents(docs.withColumn("pack_group", F.lit(1)).withColumn("sequence_id", F.lit("s")))
    assert pieces.count() == 2
    assert near_dedup.near_duplicates(docs.withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))).count() == 2
    assert suffix_dedup.remove_repeats(docs.withColumn("bucket", F.lit(1)).withColumn("rest", F.lit(2))).count() == 2


def test_part_memory_is_bounded_and_right():
    def encode(which, keys):
        n = (keys[which] % 4).astype(np.int64)
        return n, np.repeat(keys[which], n).astype(np.uint32)

    codes = part_codes.PartCodes(encode, most_parts=50, most_ids=120)
    rng = np.random.default_rng(1)
    for k in range(60):
        keys = rng.integers(0, 40 if k % 2 else 400, rng.integers(0, 90)).astype(np.uint64)
        counts, ids = codes.gather(keys, keys)
        assert counts.tolist() == (keys % 4).tolist() and ids.tolist() == np.repeat(keys, (keys % 4).astype(int)).tolist()
        assert len(codes._keys) <= 50 and len(codes._ids) <= 120


def test_word_encoder_by_columns_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_encoder.default_path())
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    parts = ["a", "it's", "'s", "é", "x1", "12", "#", "日本", "\x85", " ", "　", "\n", "\t", "  ", "Word,", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)] + [" ".join(rng.choices(["alpha", "béta", "it's", "3.5", "x\ny"], k=9)) for _ in range(300)] + [None, ""]
    got = []
    for first, counts, ids in word_encoder.encoder(word_encoder.default_path()).encode_column(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_lanes_and_the_stream_agree_with_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_path())
    model = sentence_pieces.PieceModel(sentence_pieces.default_path())
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "e", "th", " ", "ing", "é", "▁", "\n", "aaa", "😀", "\x00", "tion", "x" * 70], k=rng.randint(0, 30))) for _ in range(500)] + ["", " ", "word " * 50, None]
    got = []
    for first, counts, ids in model.encode_column(pa.array(texts)):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [library.encode(t or "") for t in texts]
    assert got == want
    for t, x in zip(texts, want):
        assert model.ids(model.stream(sentence_pieces.SPACE_PIECE + t.replace(" ", sentence_pieces.SPACE_PIECE)) if t else []) == x
        assert model.decode(np.array(x, np.int64)) == (t or "").replace("▁", " ")


def test_runs_of_codes_open_at_any_value():
    values = np.sort(np.random.default_rng(4).integers(0, 10**6, 700))
    code = id_files.EliasFano.frombytes(id_files.EliasFano.build(values).tobytes())
    for a, b in ((0, 700), (0, 1), (699, 700), (63, 66), (64, 200), (5, 5), (300, 9999)):
        assert code.run(a, b).tolist() == values[a:b].tolist()


def test_span_codes_tell_structured_strings_apart():
    morse = "".join("ab"[k.bit_count() % 2] for k in range(4096)).encode()
    esrom = morse.translate(bytes.maketrans(b"ab", b"ba"))
    for n in (16, 32, 64, 128, 1024, 2048, 4096):
        data = np.frombuffer(morse[:n] + esrom[:n] + morse[:n], np.uint8)
        x, y, z = textkernel.span_codes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert x == z != y
