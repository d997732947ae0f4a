import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from mnemospark.llm import bpe, token_files
from mnemospark.llm._words import WordEncoder, load_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = load_tokenizer(PATH)


def texts(n=400):
    r = random.Random(1)
    alphabet = list("abcXYZ 0\n\t.,'é́|<>  Σςİ½日😀\x00\x0b\x1c\x85")
    fixed = ["Hello world  ", "a\x0bb c", " <|startoftext|>x <|ENDOFTEXT|> ΣΑΣ İ é ́x", None, "", "'S it's WE'LL 123 ½ ²", "日本語 テスト😀😀 a b", "a. b, c., d.,e", "x" * 5000]
    return fixed + ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(n)]


def test_words_give_the_ids_of_whole_texts():
    t = texts(3000)
    ids, off = WordEncoder(TOKENIZER).encode(pa.array(t, pa.string()))
    for i, x in enumerate(t):
        assert ids[off[i] : off[i + 1]].tolist() == TOKENIZER.encode(x or "", add_special_tokens=False).ids, x


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr("mnemospark.llm._words.MEMO_WORDS", 3)
    e = WordEncoder(TOKENIZER)
    for x in ("one two three four five", "six seven one", "two eight"):
        assert e.encode(pa.array([x]))[0].tolist() == TOKENIZER.encode(x, add_special_tokens=False).ids


def test_automaton_is_minimal_and_ranks_words():
    words = sorted(w.encode() for w in {"tap", "taps", "top", "tops", "é", "éa", "stop", "stops"})
    parts = bpe.compile_automaton(words)
    assert len(parts["final"]) < sum(map(len, words))  # suffixes are shared
    parts["start"], parts["ids"] = np.arange(len(words) + 1), np.arange(len(words))
    t = bpe.Transducer(bpe.Transducer.packed(parts))
    assert t.find(pa.array([w.decode() for w in words])).tolist() == list(range(len(words)))
    assert t.find(pa.array(["ta", "tapss", "", "zz", "to"])).tolist() == [-1] * 5


def test_encode_and_decode_frames(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, "keep") for i, x in enumerate(t)], "doc_id long, text string, decoded string")
    lexicon = bpe.build_lexicon(df, PATH, 50)
    back = bpe.decode(bpe.encode(df, PATH, lexicon), PATH)
    for r in back.collect():
        ids = TOKENIZER.encode(t[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == TOKENIZER.decode(ids, skip_special_tokens=False)
    none = df.limit(0)
    assert bpe.encode(none, PATH, bpe.build_lexicon(none, PATH)).count() == 0


def test_files(spark):
    t = texts()
    rows = [(1000 - i, x, i) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    manifest = token_files.write_tokens(df, PATH, length=64)
    got = {r.doc_id: r for r in token_files.digest_files(manifest).collect()}
    start = 0
    for d, x, _ in sorted(rows):
        ids = [*TOKENIZER.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    for r in manifest.collect():
        f = token_files.open_file(r.path)
        mask = np.concatenate([f.get_batch(i).column("mask").values.to_numpy(zero_copy_only=False) for i in range(f.num_record_batches)])
        assert mask.sum() == r.n_tokens and mask[: r.n_tokens].all() and len(mask) % 64 == 0
        assert f.schema.field("ids").type == pa.list_(pa.uint16(), 64)
    assert token_files.digest_files(token_files.write_tokens(df.limit(0), PATH)).count() == 0
