import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import packing, piece, tokens

PATH = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")


def test_sequences_can_be_laid_out_from_the_pieces(spark, odd):
    rows = packing.pieces(odd, PATH).collect()
    room = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        room.setdefault(r.sequence_id, []).append((r.offset, ids))
    for parts in room.values():
        assert sum(len(x) for _, x in parts) == max(at + len(x) for at, x in parts)
    enc = tokens.encoder(PATH).model
    long = next(r.text for r in odd.collect() if r.doc_id == 8)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted((r for r in rows if r.doc_id == 8), key=lambda r: r.start)])
    assert whole.tolist() == [*enc.encode(long, add_special_tokens=False).ids, 1]
    assert "ids" in corpus_pipeline.pack(spark, odd, "").columns


def test_piece_ids_and_texts(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    coded = piece.encode(odd, PIECES)
    for r in coded.collect():
        want = library.encode(text[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want)
    back = {r.doc_id: r.text for r in piece.decode(coded, PIECES).collect()}
    assert back == {k: library.decode(library.encode(v)) for k, v in text.items()}
    for r in piece.digests(odd, PIECES).collect():
        ids = library.encode(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_map_of_bits_keeps_every_id(spark, monkeypatch):
    """Ids that are asked for all pass; of the others few do while the map has room, and any may when it has not."""
    from quern.llm import near

    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("name"), F.lit("x").alias("id")).union(spark.createDataFrame([(None, "x")], "name long, id string"))
    ids = rows.filter("name % 37 = 0").select(F.col("name").alias("id"))
    wanted = {r.id for r in ids.collect()}
    for most in (1 << 26, 1 << 15):
        monkeypatch.setattr(near, "MAP_BITS", most)
        told = near._maybe(rows, "name", ids)
        got = {r.name for r in told.filter("__may").collect()}
        assert wanted <= got and None not in got and len(got) < (len(wanted) * 4 if most == 1 << 26 else 5_000)
        assert told.count() == 40_001 and told.columns == ["name", "id", "__may"]
    assert near._maybe(rows, "name", ids.limit(0)).filter("__may").count() == 0
