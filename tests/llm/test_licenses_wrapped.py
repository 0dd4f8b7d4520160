import textwrap

import pytest

from corpusloom.llm import licenses as L

LONG = [t for t in range(len(L.TEMPLATES)) if len(L.words_of(L.TEMPLATES[t][1])) > 15]
PROSE = "Here the town walked along the river in spring.\nNobody minded the rain that evening."


def wrapped(t, width=45, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(L.TEMPLATES[t][1], width))


def test_needed_words_leave_no_template():
    m = L.trained()
    need = set(L.needed_words(L.CONFIRM))
    for t in range(len(L.TEMPLATES)):
        assert sum(t in ts and not need & set(g.split()) for g, ts in m.templates.items()) < L.CONFIRM * m.sizes[t]


@pytest.mark.parametrize("form", ["{}", "Title\n\n{}\n\nEnd.", PROSE + "\n{}\n" + PROSE])
def test_wrapped_notices_are_confirmed(docs_of, form):
    for mark in ("", "# "):
        docs = docs_of([form.format(wrapped(t, 45, mark)) for t in LONG])
        got = {r.doc_id: (r.n_licenses, r.families) for r in L.documents(docs).collect()}
        assert got == {i: (1, L.TEMPLATES[t][0]) for i, t in enumerate(LONG)}


def test_blocks_in_one_document(docs_of):
    mit, mpl = (next(t for t in LONG if L.TEMPLATES[t][0] == f) for f in ("MIT", "MPL"))
    texts = [
        wrapped(mit) + "\n" + PROSE + "\n" + wrapped(mpl),  # one paragraph, two notices
        wrapped(mit) + "\n \n" + wrapped(mit),  # two paragraphs
        "Released under the MIT License.\n" + PROSE,  # a line, no second time as a paragraph
        "\n\n".join(wrapped(mit).split("\n")),  # a blank line between all lines: no paragraph has it
        PROSE, "", None,
    ]
    got = {r.doc_id: (r.n_licenses, r.families) for r in L.documents(docs_of(texts)).collect()}
    assert got == {0: (2, "MIT,MPL"), 1: (2, "MIT"), 2: (1, "MIT"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (0, "")}
