import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.functions.textform import canonical


def form(*values):
    out, changed = canonical(pa.array(values, pa.string()))
    return list(zip(out.to_pylist(), changed.tolist(), strict=True))


def test_cases():
    assert form("Ｈêｔｒｅ", "hêtre", "h​être", "hêtre\xa0", "hêtrе", "ﬁn") == [
        ("Hêtre", True), ("hêtre", True), ("hêtre", True), ("hêtre", True), ("hêtre", True), ("fin", True),
    ]
    assert form("hêtre", "  a   b ", "Ω4", "lot Δ", "пень", "½ § ±", None, "") == [
        ("hêtre", False), ("a b", False), ("Ω4", False), ("lot Δ", False), ("пень", False), ("½ § ±", False), (None, False), ("", False),
    ]
    assert form("ậ", "а̂ge", "x̣́") == [("ậ", True), ("âge", True), ("x̣́", False)]


def test_empty_and_long():
    assert form() == []
    assert form("é" * 50_000)[0] == ("é" * 50_000, True)


@given(st.lists(st.text(st.sampled_from("aeçÉœx 1̧̣́̂̀̄ ñ"), max_size=8), max_size=6))
@settings(max_examples=300, deadline=None)
def test_latin_text_is_composed_like_nfc(values):
    got = [f for f, _ in form(*values)]
    assert got == [" ".join(x for x in unicodedata.normalize("NFC", v).split(" ") if x) for v in values]
    assert [f for f, _ in form(*got)] == got


def test_signs_beyond_the_basic_planes():
    values = ["ab\U000E0061\U000E0062c", "x\U000E0101y", "\U0002F800", "\u212a", "\U00020000 \U0001F600", "plain"]
    form, changed = canonical(pa.array(values))
    assert form.to_pylist() == ["abc", "xy", "\u4e3d", "K", "\U00020000 \U0001F600", "plain"]
    assert changed.tolist() == [True, True, True, True, False, False]
