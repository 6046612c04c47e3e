"""Sharding, token files, chat files and archives against plain Python."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldtable.llm import chat, common, sharding, token_store, warc
from foldtable.llm.queries import QUERIES

from .data import SF, documents, empty_documents


def same_rows(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def check_shards(rows, docs):
    key = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(key(r.doc_id, r.text) for r in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(8))


def test_shards_of_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    check_shards(rows, docs.collect())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3
    again = QUERIES["op1_sharding"](spark, SF).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_awkward_rows(spark):
    docs = documents(spark)
    check_shards(sharding.shard_documents(spark, docs).collect(), docs.collect())
    assert sharding.shard_documents(spark, empty_documents(spark)).count() == 0
    kept = sharding.write_shards(docs, common.new_path(spark, "t"))
    assert sorted(kept.columns) == sorted([*docs.columns, "slot"]) and kept.count() == docs.count()


def most_in_a_file(spark, path):
    """The most rows that one file holds."""
    return spark.read.parquet(path).groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]


def test_shards_of_rows_that_repeat(spark):
    """A third of all rows are one row, and as many have neither id nor text."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 5, if(id % 3 = 1, null, id)) as doc_id", "if(id % 3 = 0, repeat('x', 100), if(id % 3 = 1, null, string(id))) as text")
    path = common.new_path(spark, "t")
    out = sharding.write_shards(rows, path, bucket_bytes=10_000)
    assert Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter(map(tuple, rows.collect()))
    places = out.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert len(places) == 8 and all(r["max(slot)"] == r["count(1)"] - 1 == 374 for r in places)
    buckets = spark.read.parquet(path).select("_metadata.file_path").distinct().count()
    assert buckets > 30 and most_in_a_file(spark, path) < 200


def test_shards_follow_from_the_rows_alone(spark):
    """However the input is partitioned, and whatever repeats: equal rows, and rows of one id and text that differ elsewhere."""
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "if(id % 3 = 0, repeat('x', 100), string(id)) as text", "if(id % 6 = 0, id, 7) as more")
    for size in (5_000, 24 << 20):
        outs = [sharding.write_shards(df, common.new_path(spark, "t"), bucket_bytes=size).select("doc_id", "text", "more", "shard", "slot") for df in (rows.coalesce(1), rows.repartition(9))]
        assert sorted(map(tuple, outs[0].collect())) == sorted(map(tuple, outs[1].collect()))


def test_several_buckets_a_task_give_the_same(spark):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "if(id % 3 = 0, repeat('x', 100), string(id)) as text")
    outs = [sharding.write_shards(rows, common.new_path(spark, "t"), bucket_bytes=5_000, most_tasks=n).select("doc_id", "text", "shard", "slot") for n in (1, 7, 1 << 15)]
    assert len({str(sorted(map(tuple, out.collect()))) for out in outs}) == 1 and outs[0].count() == 2000


def test_bases_of_many_parts(spark):
    parts = spark.range(5000).selectExpr("int(id * 3 % 5000) as part", "id % 7 as n_tokens")
    got = dict(map(tuple, token_store._bases(parts, 64).collect()))
    sizes = dict(map(tuple, parts.collect()))
    assert len(got) == 5000 and all(got[p] == sum(sizes[x] for x in range(p)) for p in range(0, 5000, 97))


def check_tokens(rows, docs):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.no_truncation(), coder.no_padding()
    start, want = 0, []
    for i, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same_rows(rows, want)


def test_shards_keep_columns_of_any_name(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "doc_id as _hash", "'b' as _bucket", "lang as _rank", "1 as shard")
    out = sharding.write_shards(docs, common.new_path(spark, "t"))
    assert out.columns == ["doc_id", "text", "_hash", "_bucket", "_rank", "slot", "shard"]
    same_rows(out.select("doc_id", "text", "_hash", "_bucket").collect(), docs.select("doc_id", "text", "_hash", "_bucket").collect())


def test_tokens_of_documents(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    check_tokens(QUERIES["op6_token_output"](spark, SF).collect(), docs)


def test_tokens_of_awkward_rows(spark):
    docs = documents(spark)
    check_tokens(token_store.store_documents(spark, docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert token_store.store_documents(spark, empty_documents(spark)).count() == 0


def test_tokens_of_rows_that_repeat(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 5, if(id % 3 = 1, null, id)) as doc_id", "if(id % 3 < 2, 'same words', string(id)) as text")
    path = common.new_path(spark, "t")
    token_store.write_tokens(rows, path, public_tokenizers.path("word_bpe_49k.json"), part_bytes=10_000)
    got = token_store.read_tokens(spark, path).selectExpr("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows.collect()), key=lambda i: (i is not None, i))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:], strict=True))
    assert most_in_a_file(spark, path) < 600


def test_token_ranges_and_layout(spark):
    path = common.new_path(spark, "t")
    token_store.write_tokens(documents(spark), path, public_tokenizers.path("word_bpe_49k.json"), part_bytes=1 << 30)
    whole = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    some = token_store.read_tokens(spark, path, 4, 6).collect()
    assert [r.doc_id for r in sorted(some)] == [4, 5, 6] and all(r == whole[r.doc_id] for r in some)
    import pyarrow.dataset as ds

    seen = set()
    for f in ds.dataset(path.removeprefix("file://"), format="parquet").get_fragments():
        meta = f.metadata
        for k in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(k).column(c)
                seen.add((col.path_in_schema.split(".")[0], "DELTA_BINARY_PACKED" in col.encodings, col.has_offset_index))
    assert ("doc_id", True, True) in seen and ("tokens", False, True) in seen


def test_a_small_memory_of_chunks_changes_nothing():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"w{k % 7} {'z' * k} Hello, world!".encode() for k in range(50)]
    small, large = token_store.ChunkEncoder(path, held=1), token_store.ChunkEncoder(path)
    for t in texts:
        for a, b in zip(small.encode([t]), large.encode([t]), strict=True):
            assert a.tolist() == b.tolist()


def check_chat(rows, turns):
    convs = defaultdict(list)
    for t in turns:
        convs[t.conv_id].append(t)
    convs[-1] = [type("T", (), {"turn": k, "role": r, "text": chat.PLANTED}) for k, r in enumerate(("user", "assistant"))]
    assert len(rows) == len(convs)
    for r in rows:
        mine = sorted(convs[r.conv_id], key=lambda t: t.turn)
        said = "".join(f"{t.role or ''}\n{t.text or ''}\n" for t in mine)
        loss = "".join(t.text or "" for t in mine if t.role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha(said), len(loss), sha(loss))
        assert r.formatted_chars >= len(said)


def test_chat(spark):
    check_chat(QUERIES["op3_chat_formatting"](spark, SF).collect(), common.table(spark, SF, "conversations").collect())


def test_chat_of_awkward_rows(spark):
    rows = [(c, k, r, t, "x") for c in (5, None) for k, (r, t) in enumerate([("system", None), ("us\ner\\n", "a\\<|b<\\|c\\0\\\\"), ("assistant", ""), (None, "<|im_end|>\n"), ("assistant", "\\n<|im_start|>é\U0001f600")])]
    turns = spark.createDataFrame([*rows, (6, None, "assistant", "z", "y")], "conv_id long, turn long, role string, text string, seq string")
    check_chat(chat.format_conversations(spark, turns).collect(), turns.collect())
    assert chat.format_conversations(spark, turns.limit(0)).count() == 1


def test_turns_that_tie(spark):
    """Of one conversation and turn: by role, then by the whole text, however long what they begin with."""
    texts = [*"lkjihgfedcba", *["p" * 300 + c for c in "zyx"], "p" * 300, *["same"] * 9]
    turns = spark.createDataFrame([(1, 0, r, t) for t in texts for r in ("user", "assistant")], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(spark, turns.repartition(5)).where("conv_id = 1").collect()
    said = "".join(f"{r}\n{t}\n" for r in ("assistant", "user") for t in sorted(texts))
    assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    path = common.new_path(spark, "t")
    many = spark.range(4000).selectExpr("1L as conv_id", "if(id % 2 = 0, 3L, id) as turn", "'user' as role", "if(id % 2 = 0, 'again', string(id)) as text")
    chat.write_examples(many, path, part_bytes=5_000)
    assert most_in_a_file(spark, f"{path}/ordered") < 400
    assert [r.seq for r in spark.read.parquet(f"{path}/segments").orderBy("seq").collect()] == list(range(4000))


def test_rendered_examples(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "so"), (1, 3, "assistant", "bc")], "conv_id long, turn long, role string, text string")
    path = common.new_path(spark, "t")
    chat.write_examples(turns, path)
    got = chat.render(*chat.read_examples(spark, path)).orderBy("seq").collect()
    assert [r.text[r.context_chars :] for r in got] == ["a", "bc"]
    assert got[1].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nso<|im_end|>\n<|im_start|>assistant\nbc"


def test_rendered_examples_of_a_table(spark):
    turns = common.table(spark, SF, "conversations")
    path = common.new_path(spark, "t")
    chat.write_examples(turns, path)
    escaped = lambda x: (x or "").replace("\\", "\\\\").replace("<|", "<\\|")
    convs, want = defaultdict(list), []
    for t in sorted(turns.collect(), key=lambda t: t.turn):
        convs[t.conv_id].append(t)
    for conv, mine in convs.items():
        whole = ""
        for k, t in enumerate(mine):
            head = f"<|im_start|>{t.role}\n"
            if t.role == "assistant":
                want.append((conv, k, whole + head + escaped(t.text), len(whole + head)))
            whole += f"{head}{escaped(t.text)}<|im_end|>\n"
    same_rows([(r.conv_id, r.seq, r.text, r.context_chars) for r in chat.render(*chat.read_examples(spark, path)).collect()], want)


def test_examples_that_are_not_their_context_are_errors():
    chat._checked("assistant", 9, 40, 60, 40, 40 + 13 + 9, 100 - 11)
    chat._checked("user", 4, 40, 60, 40, None, None)
    for wrong in (("assistant", 9, 40, 60, 40, None, None), ("user", 4, 40, 60, 40, 57, 89), ("assistant", 9, 40, 60, 40, 61, 89), ("assistant", 9, 41, 60, 40, 62, 89)):
        with pytest.raises(ValueError):
            chat._checked(*wrong)


def check_warc(rows, pages):
    largest = {}
    for p in pages:
        largest[p.html or ""] = max(p.page_id if p.page_id is not None else -1, largest.get(p.html or "", -1))
    want = []
    for p in pages:
        b, top = (p.html or "").encode(), largest[p.html or ""]
        same = top == -1 or top == p.page_id
        want.append((p.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else top))
    same_rows(rows, want)


def test_warc(spark):
    check_warc(QUERIES["op9_warc"](spark, SF).collect(), common.table(spark, SF, "pages").collect())


def test_warc_of_awkward_rows(spark):
    html = [None, "", "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n</p>", "é" * 5000, "same", "same", "same", None, "\r\n"]
    rows = [(k, None if k == 3 else f"http://x/\r\n {k}", h, "z") for k, h in enumerate(html)]
    pages = spark.createDataFrame([*rows, rows[4], rows[6], (None, "u", "same", "q"), (None, "u", "alone", "q")], "page_id long, url string, html string, original string")
    check_warc(warc.archive_pages(spark, pages).collect(), pages.collect())
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0
    path = common.new_path(spark, "t")
    warc.write_warc(pages, path, min_bytes=5)
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 0


def test_warc_of_rows_that_repeat(spark):
    """Rows without id, and rows of one id, that share a payload fill more than one archive."""
    pages = spark.range(3000).selectExpr("if(id % 3 = 0, 5, if(id % 3 = 1, null, id)) as page_id", "'u' as url", "if(id % 3 = 2, string(id), repeat('same', if(id % 3 = 0, 20, 30))) as html")
    pages = pages.unionAll(spark.sql("select 9000L, 'u', repeat('same', 30)"))
    check_warc(warc.archive_pages(spark, pages).collect(), pages.collect())
    path = common.new_path(spark, "t")
    warc.write_warc(pages, path, archive_bytes=50_000)
    read = warc.read_warc(spark, path)
    check_warc(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), pages.collect())
    ids = [r.record_id for r in read.collect()]
    assert len(set(ids)) == len(ids) == pages.count()
    records = spark.read.option("lineSep", "\r\n").text(path).where("value = 'WARC/1.1'").groupBy(F.input_file_name()).count()
    assert records.agg({"count": "max"}).first()[0] < 600
