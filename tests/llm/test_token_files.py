import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import token_files as T
from test_common import twins

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1)))
@settings(max_examples=50, deadline=None)
def test_coding_round_trip(values):
    x = np.array(values, np.uint32)
    assert (T.unpack(*T.pack(x), len(x)) == x).all()


def test_words_encode_like_whole_texts():
    import pyarrow as pa

    texts = ["It's A test, isn't it?  End.", "a\x01b \x01 c", "<|endoftext|> x<|ENDOFTEXT|>y", "Étude É é É.\n\n…, ,…. 12.5 ß İ ΑΣ", "", None, " x y\x1cz", "don't. we'll, 's"]
    whole = Tokenizer.from_file(PATH)
    ids, at = T.WordEncoder(PATH).encode(pa.array(texts), 2)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_memory_bound_of_the_words_changes_nothing():
    import pyarrow as pa

    small, large = T.WordEncoder(PATH, most=3), T.WordEncoder(PATH)
    for texts in (["a b c", "c d"], ["e f g h i"], ["a c i"]):
        assert [x.tolist() for x in small.encode(pa.array(texts), 2)] == [x.tolist() for x in large.encode(pa.array(texts), 2)]


def test_digests_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "again"), (900003, "again"), (-5, "Word " * 30000), (None, "no id")], "doc_id long, text string")
    rows = sorted(docs.union(extra).collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    whole, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = T.token_file_digests(docs.union(extra).withColumn("ids", docs["doc_id"]).repartition(5), PATH).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert T.token_file_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_of_equal_hash_keep_their_own_ids():
    import pyarrow as pa

    from test_common import made_up

    pairs = [*made_up(), ("qnaghhjtaaadaaaa", "dsojfdwhbkkzriad")]
    whole, encoder = Tokenizer.from_file(PATH), T.WordEncoder(PATH)
    texts = [" ".join(w for p in pairs for w in p), *(w for p in pairs for w in p), *(w for p in pairs for w in reversed(p)), " ".join(b for _, b in pairs)]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for part in (texts, texts[:1], texts[5:]):  # in one piece, and against words kept from before
        ids, at = encoder.encode(pa.array(part), 2)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [want[texts.index(t)] for t in part]
