"""Operators that treat one document at a time, or all documents together, against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridscore.llm import langid, media, mixing, pieces, quality, queries, sharding, tokens


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ODD = [(1, None, None, None), (2, "", "en", "s1"), (3, "a b", "en", "s1"), (3, "a b", "en", "s1"), (None, "c d e", None, None), (4, "x y " * 20000, "fr", "s2"), (5, "▁ é 😀\x00\ttab", "de", "s2")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"size": F.lit("clash"), "score": F.lit("clash"), "shard": F.lit("clash")})


def test_shards(spark, sf_dir, docs):
    found = queries.op9_sharding(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    plain = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    size = np.array([len(t.encode()) + 16 for t in plain.text])
    before = np.cumsum(size) - size
    shard = np.minimum(39, (2 * before + size) * 40 // (2 * size.sum()))
    assert (found["size"] == size).all() and (found["shard"] == shard).all()
    assert found.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in plain.text]
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sums = found.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * size.max()


def test_shards_of_odd_rows(spark, odd, tmp_path):
    found = sharding.shard_by_bytes(odd, 3).collect()
    assert sorted(r["size"] for r in found) == sorted(16 + len((t or "").encode()) for _, t, _, _ in ODD)
    assert sorted((r.shard, r.slot) for r in found) == sorted({(r.shard, r.slot) for r in found})
    assert sharding.shard_by_bytes(odd.limit(0), 3).count() == 0
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD) and back.where("shard < 2").count() == sum(r.shard < 2 for r in found)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 3071, 3072, 3073, 40000])
def test_stream_round_trip(n):
    payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)).ljust(max(192, -(-n // 192) * 192), b" ")
    stream = media.mux(payload)
    s = media.demux(stream)
    assert s.payload == payload and s.discontinuities == 0 and len(stream) % 188 == 0 and s.random_access[0]
    if len(stream) > 188 * 5:
        lost = stream[: 188 * 3] + stream[188 * 4 :]  # a packet is gone
        assert media.demux(lost).discontinuities == 1
    broken = bytearray(stream)
    broken[10] ^= 255
    with pytest.raises(ValueError, match="table"):
        media.demux(bytes(broken))


def _packet(pid, counter, payload, start=False, adaptation=None):
    """A packet by hand: header, an adaptation field (its bytes after the length), payload; stuffed in front to 188 bytes."""
    field = None if adaptation is None and len(payload) == 184 else bytes(adaptation or b"")
    if field is not None:
        room = 188 - 4 - 1 - len(payload)
        field = bytes([room]) + (field or (b"\x00" if room else b"")).ljust(room, b"\xff")
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x20 if field is not None else 0) | (0x10 if payload else 0) | counter])
    out = head + (field or b"") + payload
    assert len(out) == 188
    return out


def _with_crc(section):
    crc = 0xFFFFFFFF
    for byte in section:  # the standard's register, bit by bit
        for k in range(7, -1, -1):
            bit = (crc >> 31) ^ (byte >> k & 1)
            crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if bit else 0)
    return section + crc.to_bytes(4, "big")


def test_a_stream_written_by_hand_is_read():
    """Bytes after ISO/IEC 13818-1, not after the writer: a network entry, two programs, a section that spans packets and one
    that begins behind another, streams of other types, a repeated packet, an announced jump, a null packet."""
    pat = _with_crc(bytes([0, 0xB0, 9 + 12, 0, 7, 0xC1, 0, 0, 0, 0, 0xE0, 0x10, 0, 5, 0xE2, 0x00, 0, 9, 0xE3, 0x00]))
    described = bytes([0x05, 200]) + b"x" * 200  # a descriptor that makes the map longer than a packet
    body = bytes([0, 5, 0xC1, 0, 0, 0xE1, 0x23, 0xF0, 0]) + bytes([0x1B, 0xE1, 0x22, 0xF0 | len(described) >> 8, len(described) & 0xFF]) + described + bytes([0x06, 0xE1, 0x23, 0xF0, 0])
    later = _with_crc(bytes([2, 0xB0 | (len(body) + 4) >> 8, (len(body) + 4) & 0xFF]) + body[:2] + b"\xc0" + body[3:])  # not in force yet
    pmt = _with_crc(bytes([2, 0xB0 | (len(body) + 4) >> 8, (len(body) + 4) & 0xFF]) + body)
    line = later + pmt  # the second begins where the first ends, in a packet's middle
    rest, at = [], 183
    rest.append(_packet(0x200, 0, b"\x00" + line[:183], start=True))
    while at < len(line):
        begins = at < len(later) <= at + 183  # the pointer is there only where a section begins
        room = 183 if begins else 184
        piece = line[at : at + room]
        payload = (bytes([len(later) - at]) if begins else b"") + piece
        rest.append(_packet(0x200, len(rest), payload.ljust(184, b"\xff"), start=begins))
        at += room
    data = bytes(range(256)) * 2
    stamp = lambda t: bytes([0x21 | t >> 29 & 14, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])
    pes = lambda t, part: b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(t) + part
    one, two = pes(0x1_2345_6789, data[:300]), pes(0x1_2345_7000, data[300:])
    clock = bytes([0x50, 1, 2, 3, 4, 5, 6])
    first = _packet(0x123, 14, one[:176], True, clock)
    repeat = _packet(0x123, 14, one[:176], True, bytes([0x50, 9, 9, 9, 9, 9, 9]))  # the same packet with another clock reference
    own = [first, repeat, _packet(0x123, 15, one[176:], adaptation=b""), _packet(0x123, 15, b"", adaptation=b"\x00".ljust(183, b"\xff")), _packet(0x123, 3, two[:182], True, b"\x80"), _packet(0x123, 4, two[182:], adaptation=b"")]
    null, other = _packet(0x1FFF, 0, b"\xff" * 184), _packet(0x122, 0, b"\x00\x00\x01\xe0".ljust(184, b"v"), True)
    packets = [null, _packet(0, 0, (b"\x00" + pat).ljust(184, b"\xff"), True), *rest, other, *own[:2], null, *own[2:], other]
    s = media.demux(b"".join(packets))
    assert s.payload == data and s.pts.tolist() == [0x1_2345_6789, 0x1_2345_7000] and s.unit_bytes.tolist() == [300, len(data) - 300]
    assert (s.pid, s.stream_type, s.programs, s.discontinuities) == (0x123, 6, 2, 0) and s.random_access.tolist() == [True, False]
    jump = [_packet(0x123, 3, two[:182], True, b"\x00") if p is own[4] else p for p in packets]
    assert media.demux(b"".join(jump)).discontinuities == 1
    with pytest.raises(ValueError, match="no stream"):
        media.demux(b"".join(packets), 0x0F)
    with pytest.raises(ValueError, match="missing"):
        media.demux(b"".join(packets[2:]))


def test_media_query(spark, sf_dir, docs, odd):
    import hashlib

    found = queries.op10_media_columns(spark, sf_dir).toPandas().set_index("doc_id")
    for r in docs.limit(40).collect():
        n, payload = media.padded(r.text)
        row = found.loc[r.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert row.media_sha256 == hashlib.sha256(media.mux(payload)).hexdigest() and "discontinuities=0" in row.feature
    assert media.describe_media(odd).count() == len(ODD) and media.describe_media(odd.limit(0)).count() == 0
    r = media.media_column(odd).where("doc_id = 2").first()
    assert len(r.pts) == 1 and r.random_access == [True] and media.demux(bytes(r.media)).payload == b" " * 192


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op2_quality(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    assert (held.predicted == held.q).mean() > 0.97 and (held[held.q == 1].predicted == 1).mean() > 0.98
    assert scored.held_out.tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored.doc_id]


def test_quality_edge_cases(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    empty = quality.fit(odd.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(odd.drop("score"), empty).collect()} == {0.5}


def test_mix(spark, sf_dir, docs):
    found = queries.op3_mixing(spark, sf_dir).toPandas()
    again = queries.op3_mixing(spark, sf_dir).toPandas()
    key = ["doc_id", "taken"]
    assert found.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    sizes = {r.doc_id: len(r.text.split()) for r in docs.collect()}  # these texts hold no other white space
    assert dict(zip(found.doc_id, found["size"], strict=True)) == sizes
    own = docs.toPandas().assign(size=lambda d: d.doc_id.map(sizes)).groupby("source")["size"].sum().sort_index()
    weight = np.array([5, 2, 1] * len(own), dtype=float)[: len(own)]
    target, rest = np.zeros(len(own)), 1.5 * own.sum()
    open_ = np.ones(len(own), dtype=bool)
    while True:  # what is above twice a source's size is cut and shared again
        share = np.where(open_, rest * weight / weight[open_].sum(), target)
        over = open_ & (share > 2 * own.to_numpy())
        if not over.any():
            break
        target[over] = 2 * own.to_numpy()[over]
        rest, open_ = 1.5 * own.sum() - target[~open_ | over].sum(), open_ & ~over
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert by.target.to_numpy() == pytest.approx(share)
    assert (found.taken <= 2 * found["size"]).all()
    assert (by.taken - by.target).abs().max() <= found["size"].max() / 2


def test_pivotal_steps_keep_expectations(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    found = mixing.mix(rows).toPandas()
    for _, part in found.groupby("source"):
        p = part.target.iloc[0] / part.source_size.iloc[0]
        assert (part.copies * part["size"]).sum() == pytest.approx(part.target.iloc[0], abs=1)
        assert part.copies.mean() == pytest.approx(p, abs=0.05)
    small = found[found["size"] <= 3]
    assert small.copies.mean() == pytest.approx(found.copies.mean(), abs=0.1)


def test_mix_edge_cases(spark, odd):
    found = mixing.mix(odd)
    assert found.count() == len(ODD) and found.where("copies < 0 or copies > 2").count() == 0
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns and rows.count() == found.agg(F.sum("copies")).first()[0]
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_token_counts(spark, sf_dir, docs, odd, tmp_path):
    found = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, sf_dir).collect()}
    tool = tokens.encoding()
    assert found == {r.doc_id: len(tool.encode_ordinary(r.text)) for r in docs.collect()}
    expected = Counter((d, len(tool.encode_ordinary(t or ""))) for d, t, _, _ in ODD)
    places = tokens.write_flat(odd, f"file://{tmp_path}/ids")
    for size in (2, 6, 50, 1 << 20):  # blocks of one id, of three, of some, of all
        counts = places.join(tokens.count_tokens(places, f"file://{tmp_path}/ids", block_bytes=size), ["file", "at"])
        assert Counter((r.doc_id, r.n_tokens) for r in counts.collect()) == expected
    assert tokens.document_tokens(spark, odd.limit(0)).count() == 0


def test_flat_file_without_a_last_separator(spark, tmp_path):
    np.array([5, 6, tokens.SEPARATOR, tokens.SEPARATOR, 7], dtype="<u2").tofile(tmp_path / "a.ids")
    (tmp_path / "b.ids").write_bytes(b"")
    files = spark.createDataFrame([("a.ids",), ("b.ids",)], "file string")
    for size in (2, 4, 100):
        found = tokens.count_tokens(files, f"file://{tmp_path}", block_bytes=size).orderBy("at").collect()
        assert [(r.file, r.at, r.n_tokens) for r in found] == [("a.ids", 0, 2), ("a.ids", 1, 0), ("a.ids", 2, 1)]


def test_language_of_documents_and_pages(spark, sf_dir, docs):
    found = queries.op6_language_id(spark, sf_dir)
    own = docs.join(found.where("doc_id is not null").select("doc_id", "language", "accepted"), "doc_id")
    assert own.count() == docs.count() and own.where("language <> lang or not accepted").count() <= 0.01 * docs.count()
    pages = langid.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "declared")
    seen = pages.join(found.where("page_id is not null").select("page_id", "language"), "page_id")
    assert seen.count() == pages.count() and seen.where("declared = language").count() >= 0.98 * pages.count()


RARE = ["Suomen kieli kuuluu itämerensuomalaisiin kieliin ja sitä puhutaan pääosin Suomessa", "Järven rannalla oli hiljaista ja aurinko laski hitaasti metsän taakse kun he palasivat"]


def test_rare_languages_and_those_of_pages_only_are_learnt(spark, tmp_path):
    own = "the house of %d stands where the river and the road of this old town have met"
    docs = spark.createDataFrame([(k, own % k, "en", "s1") for k in range(3000)] + [(3000 + k, t, "fi", "s2") for k, t in enumerate(RARE)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    polish = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Jezioro było spokojne, a słońce powoli zachodziło za lasem, kiedy wracali"]
    rows = [(k, f"https://a{k}.example.pl/", f'<html lang="pl"><body><p>{t}</p></body></html>') for k, t in enumerate(polish)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op6_language_id(spark, str(tmp_path))
    rare = found.where("doc_id >= 3000 or page_id is not null").orderBy("doc_id", "page_id").collect()
    assert [(r.language, r.accepted) for r in rare] == [("pl", True)] * 2 + [("fi", True)] * 2
    assert found.where("language = 'en' and accepted").count() == 3000


def test_copies_of_a_text_are_fitted_on_once(spark):
    texts = [(f"the house of {k} stands where the river and road meet and {k * 7919} people live", "en") for k in range(300)] + [(f"la maison {k} est au bord de la riviere", "fr") for k in range(30)]
    once = spark.createDataFrame(texts, "text string, lang string")
    often = spark.createDataFrame(texts + [texts[k] for k in (5, 6, 7, 301) for _ in range(1000)], "text string, lang string")
    for rows in (20, 400):
        one, two = langid.fit_text(once, rows=rows), langid.fit_text(often, rows=rows)
        assert one.languages == two.languages == ["en", "fr", "und"] and np.array_equal(one.table, two.table)
    assert not np.array_equal(langid.fit_text(once, rows=20).table, langid.fit_text(once, rows=400).table)


def test_evidence_decides_where_text_is_short(spark, docs):
    model = langid.fit_text(docs)
    many = docs.where("lang = 'fr'").select("text", F.lit(None).cast("string").alias("declared"), F.lit("fr.example.net").alias("host"))
    some = docs.where("lang = 'en'").select("text", F.lit("en-GB").alias("declared"), F.lit("a.example.org").alias("host"))
    odd = spark.createDataFrame([("a", None, "fr.example.net"), ("a", "en", None), ("", "en", None), ("123 $$$", "en", None), (None, None, None), ("她在中国的大学里学习了很多年", "en", "a.example.org")], "text string, declared string, host string")
    rows = langid.identify(many.unionByName(some).unionByName(odd).withColumn("id", F.monotonically_increasing_id()).withColumn("language", F.lit("clash")), model)
    tail = [(r.language, r.accepted) for r in rows.orderBy(F.desc("id")).limit(6).collect()][::-1]
    assert tail[0][0] == "fr" and tail[1][0] == "en"
    assert tail[2:] == [("und", False)] * 4
    assert langid.identify(odd.limit(0), model).count() == 0


def test_accepted_documents_keep_their_columns(spark, odd, docs):
    kept = langid.accepted_only(docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source")), langid.fit_text(docs))
    assert kept.columns == ["doc_id", "text", "lang", "source"]
    assert kept.where("text is null or text = ''").count() == 0 and kept.count() >= docs.count()


def test_pieces_agree_with_the_library_and_decode(spark, docs):
    tool = pieces.Pieces(pieces.MODEL)
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in docs.limit(60).collect()] + [" a  b\n\tc  é ½ \x00 😀  ", "", "   ", "ab" * 4000]
    assert tool.encode_all(texts, [0] * len(texts), 0.0) == other.encode(texts)
    for key in (1, 2):
        assert [tool.decode(ids) for ids in tool.encode_all([*texts, "▁x ▁"], [key] * (len(texts) + 1), 0.3)] == [*texts, "▁x ▁"]
    words = [w for t in texts[:20] for w in tool.split(" " + t) if len(w) <= pieces.CACHED]
    assert tool._words(words, 9, 0.2) == [tool._word(w, 9, 0.2) for w in words]


def _naive(tool, text, key, dropout):
    """The rule as it is stated, over the whole text at once: of all neighbours that some piece joins and that aren't
    skipped, the best-ranked, leftmost ones are joined or, by their hash, skipped for good."""
    mask = (1 << 64) - 1

    def skipped(start, stop):
        z = key + start * 0x9E3779B97F4A7C15 + stop * 0xC2B2AE3D27D4EB4F & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31 < min(mask, int(dropout * (1 << 64)))

    whole = " " + text
    ends = list(range(len(whole) + 1))  # bounds of symbols
    gone = set()
    while True:
        found = [(tool.rank[whole[a:c]], a, c) for a, c in zip(ends, ends[2:], strict=False) if whole[a:c] in tool.rank and (a, c) not in gone]
        if not found:
            break
        _, a, c = min(found)
        if skipped(a, c):
            gone.add((a, c))
        else:
            ends = [e for e in ends if e <= a or e >= c]
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        out += [tool.ids[whole[a:b]]] if whole[a:b] in tool.ids else [tool.byte_ids[x] for x in whole[a:b].encode()]
    return out


def test_dropout_is_that_of_the_plain_rule(spark, docs):
    tool = pieces.Pieces(pieces.MODEL)
    texts = [r.text[:300] for r in docs.orderBy("doc_id").limit(12).collect()] + ["a  b\n\tc  é ½ \x00 😀", "ab" * 60, "x" * 90, "internationalization, internationalization!", "▁ ▁a", " "]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        keys = [k * 0x9E3779B97F4A7C15 % 2**64 for k in range(len(texts))]
        assert tool.encode_all(texts * 3, keys * 3, dropout) == [_naive(tool, t, k, dropout) for t, k in zip(texts, keys, strict=True)] * 3
    query = {r.doc_id: r.pieces for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    marks = {r.doc_id: r.mark % 2**64 for r in spark.range(len(texts)).select(F.col("id").alias("doc_id"), F.xxhash64(F.lit(42), F.lit(0.1), "id").alias("mark")).collect()}
    assert query == {k: _naive(tool, t, marks[k], 0.1) for k, t in enumerate(texts)}


def test_every_document_and_place_has_its_own_dropout(spark, docs):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("The internationalization of things").alias("text"))
    assert len({tuple(r.pieces) for r in pieces.encode(rows).collect()}) > 20
    tool = pieces.Pieces(pieces.MODEL)
    seen: list[list[bytes]] = []
    for i in tool.encode(" internationalization" * 300, 5, 0.1):
        if tool.bytes_[i].startswith(b" "):
            seen.append([])
        seen[-1].append(tool.bytes_[i])
    assert len(set(map(tuple, seen))) > 5
    # the trees of agendas, when they are new, known, and begun anew, against one agenda a word
    texts = [r.text for r in docs.limit(40).collect()] + ["a\tb é ½ \x00 😀 " + "ab" * 3000 + " end", "", None, "   "]
    keys = [k * 0x9E3779B97F4A7C15 % 2**64 for k in range(len(texts))]
    plain = []
    for t, key in zip(texts, keys, strict=True):
        at, out = 0, []
        for w in tool.split(" " + t) if t else []:
            out += tool._word(w, key, 0.2, at)
            at += len(w)
        plain.append(out)
    assert tool.encode_all(texts, keys, 0.2) == plain and tool.encode_all(texts, keys, 0.2) == plain
    tool.paths = pieces.Paths(tool)
    assert tool.encode_all(texts[::-1], keys[::-1], 0.2)[::-1] == plain and [tool.encode(t, k, 0.2) for t, k in zip(texts, keys, strict=True)] == plain


def test_dropout_varies_by_seed_and_document_and_repeats(spark, odd):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("The internationalization of things").alias("text"))
    seg = lambda **k: {r.doc_id: tuple(r.pieces) for r in pieces.encode(rows, **k).collect()}
    one = seg()
    assert one == seg() and 2 <= len(set(one.values())) <= pieces.VARIANTS and one != seg(seed=7)
    assert len(set(seg(dropout=0.0).values())) == 1
    found = pieces.encode(odd)
    assert found.where("not lossless").count() == 0 and found.count() == len(ODD)
    back = Counter((r.doc_id, r.text) for r in pieces.decode(found).collect())
    assert back == Counter((d, t or "") for d, t, _, _ in ODD)
    assert pieces.encode(odd.limit(0)).count() == 0
