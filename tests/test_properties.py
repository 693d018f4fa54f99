import json

from hypothesis import given, settings
from hypothesis import strategies as st

from inkveil.functions import context, names, scanner
from inkveil.functions.register import ALL
from inkveil.functions.scanner import to_bytes, to_text
from inkveil.operators.jsonrules import walk

TREES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=20)


@given(st.dictionaries(st.text(), TREES, max_size=4), st.sampled_from([None, 2]))
@settings(max_examples=150, deadline=None)
def test_json_keep_is_identity(tree, indent):
    text = json.dumps(tree, indent=indent, ensure_ascii=False)
    kept = walk(text, lambda path, raw: raw)
    assert json.loads(kept) == tree and kept == json.dumps(tree, separators=(",", ":"), ensure_ascii=False)


@given(st.dictionaries(st.text("ab", min_size=1), st.text() | st.integers() | st.dictionaries(st.text("ab", min_size=1), st.text(), max_size=3), max_size=4))
@settings(max_examples=150, deadline=None)
def test_json_paths(tree):
    seen = {}
    walk(json.dumps(tree), lambda path, raw: seen.setdefault(path, raw) or raw)
    want = {}
    for k, v in tree.items():
        want.update({f"{k}.{i}": json.dumps(x) for i, x in v.items()} if isinstance(v, dict) else {k: json.dumps(v)})
    assert seen == want


@given(st.text(max_size=80) | st.text("0123456789 -.()+@:/#AaBbDdMmRrNn,é\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_spans_are_ordered_and_within(text):
    data = to_bytes(text)
    for found in (scanner.find(data, ALL), context.find(data)):
        end = 0
        for m in found:
            assert end <= m.start <= m.redact <= m.end <= len(data)
            end = m.end
    assert to_text(data) == text


@given(st.lists(st.text("ab '-.", min_size=1, max_size=6), max_size=5), st.text("ab '-.Cé1", max_size=40))
@settings(max_examples=200, deadline=None)
def test_dictionary_against_every_place(known, text):
    data, folded = to_bytes(text), names.fold(to_bytes(text))
    table = {names.fold(to_bytes(n)): i for i, n in enumerate(known)}
    spans = [names.Span(a, b, table[folded[a:b]]) for a in range(len(data)) for b in range(a + 1, len(data) + 1) if folded[a:b] in table and (a == 0 or data[a - 1] in names._FREE) and (b == len(data) or data[b] in names._FREE)]
    assert names.forward([to_bytes(n) for n in known]).find(data) == names.greedy(spans)
