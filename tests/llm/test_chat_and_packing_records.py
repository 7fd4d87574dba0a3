"""Records that are odd, and ids that need all of their bits."""

import json

import pytest
from factdrift.llm import chat, packing
from factdrift.llm.queries import PACK_END, tokenizer_path
from factdrift.llm.bpe import load_tokenizer


def turns_of(spark, *records):
    rows = [(k, 0, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)]
    found = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, position long, record string")).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.k)):
        out.setdefault(r.conv_id, []).append((r.role, r.text, r.unmapped is not None))
    return [out.get(k, []) for k in range(len(records))]


def test_empty_required_fields_are_turns(spark):
    found = turns_of(
        spark,
        {"prompt": "", "response": "b"},
        {"instruction": "i", "output": None},
        {"instruction": "i", "input": "", "output": "o"},
        {"system": "s", "prompt": "p", "response": ""},
        {"messages": []},
    )
    assert found == [
        [("user", "", False), ("assistant", "b", False)],
        [("user", "i", False), ("assistant", "", False)],
        [("user", "i", False), ("assistant", "o", False)],
        [("system", "s", False), ("user", "p", False), ("assistant", "", False)],
        [],
    ]


def test_records_without_a_mapping_are_kept_and_end_nothing(spark):
    odd = [
        {"messages": [{"role": "user"}, {"content": "hi"}]},
        {"messages[]": {"role": "user", "content": "hi"}},
        {"messages": [{"role": "user", "content": "hi", "name": "x"}]},
        {"messages": ["hi"]},
        {"messages[](.content;.role)": 1},
        {"role.x": "user", "content": "hi"},
        '{"role": "user", "content": "\\ud800"}',
        '{"\\ud800": 1}',
        "[" * 100_000,
        '{"a":' * 5_000 + "1" + "}" * 5_000,
        "nothing",
        "7",
        None,
    ]
    found = turns_of(spark, *odd, {"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]})
    for record, got in zip(odd, found, strict=False):
        raw = record if isinstance(record, str) or record is None else json.dumps(record)
        assert [(role, text) for role, text, _ in got] == [(None, raw)]
    assert found[-1] == [("user", "hi", False), ("assistant", "yo", False)]


def test_unmapped_records_are_no_turns(spark):
    rows = [(1, 0, "nothing"), (1, 1, json.dumps({"role": "user", "text": "a"})), (2, 0, '{"x": 1}')]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, position long, record string"))
    found = chat.digest_conversations(chat.format_turns(turns)).collect()
    assert [(r.conv_id, r.n_turns) for r in found] == [(1, 1)]


def test_template_is_reversible(spark):
    texts = ["\\", "<|", "<\\|", "\\<|end|>", chat.END, chat.TURN + chat.TEXT, "\\\\|", "a\nb", "", None, "é漢<|"]
    rows = [(k, 0, 0, "assistant" if k % 2 else "us<|er", t) for k, t in enumerate(texts)]
    frame = chat.format_turns(spark.createDataFrame(rows, "conv_id long, position long, k long, role string, text string"))
    for r in frame.collect():
        (turn,) = filter(None, r.formatted.split(chat.END))
        role, text = turn.removeprefix(chat.TURN).split(chat.TEXT)
        assert (chat.unescaped(role), chat.unescaped(text)) == (r.role, r.text or "")
        if r.role == "assistant":
            assert chat.unescaped(r.formatted[r.loss_start : r.loss_end]) == (r.text or "")


@pytest.mark.parametrize("partitions", [1, 3])
def test_large_ids_stay_beside_a_null_id(spark, partitions):
    ids = [2**53 + 1, 2**53 + 3, None, -(2**62) - 1, 2**63 - 1, None]
    texts = ["a b c " * k for k in range(1, 7)]
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(partitions)
    found = packing.pack(frame, tokenizer_path(), PACK_END, length=16, open_windows=2).collect()
    tokenizer = load_tokenizer(tokenizer_path())
    expected = {}
    for i, text in zip(ids, texts):
        expected[i] = expected.get(i, 0) + len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == expected
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n == 16 or n & (n - 1) == 0 for n in ends.values())
