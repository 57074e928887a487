import random
import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from loomline.llm.keys import form_key, words


def test_form_key_ignores_form():
    base = form_key("Größe: wie groß ist's, bitte?")
    assert base == form_key("  GRÖSSE wie​ GROSS ists bitte")
    assert form_key("été") == form_key("ÉTÉ")
    assert form_key("ete") != form_key("été")
    assert form_key(None) == form_key(" ?! _") == ""


def test_form_key_orders_labelled_fields():
    one = "Task: sort x | Data: y rows | Model: tree z"
    two = "model : TREE z; DATA:y rows\nTask:\tsort x"
    assert form_key(one) == form_key(two)
    assert form_key(one) != form_key("Task: y rows | Data: sort x | Model: tree z")
    assert form_key("For Ann's data: what now?") == "forannsdatawhatnow"


@given(st.text(max_size=40))
def test_words_are_runs_of_letters_and_digits(x):
    runs, run = [], ""
    for c in unicodedata.normalize("NFC", x).lower():
        if c.isalnum():
            run += c
        elif run:
            runs.append(run)
            run = ""
    assert words(x) == runs + [run] * bool(run)


def test_shuffled_fields_keep_their_key():
    fields = ["Task: a b", "Data: c d", "Model: e", "Goal: f g"]
    keys = set()
    for _ in range(10):
        random.shuffle(fields)
        keys.add(form_key(" | ".join(fields)))
    assert len(keys) == 1
