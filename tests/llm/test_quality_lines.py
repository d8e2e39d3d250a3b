"""Lines that documents of a host share: counted in documents, whatever the host's size."""

from siltscope.llm import quality

FOOTER = "all rights of this page belong to the good people who made it"


def body(i):
    """Thirty words of letters (digits are one sign in a line) that no other document has."""
    name = "".join("abcdefghij"[int(c)] for c in str(i))
    return " ".join(f"{name}z{'abcdefghij'[j % 10]}{'klm'[j // 10]}" for j in range(30))


def line_words(df):
    return {(r.doc_id, r.n_words): r.n_line_words for r in quality.line_rules(df, line_docs=20).collect()}


def test_a_growing_host_never_gets_a_line_back(docs):
    for n in (40, 2500, 6000):
        got = line_words(docs(*[(i, body(i) + ("\n" + FOOTER if i < 30 else "")) for i in range(n)]))
        assert sum(v > 0 for v in got.values()) == 30


def test_a_repeated_document_counts_once(docs):
    rows = [(i, f"{body(i)}\n{FOOTER}") for i in range(19)]
    assert not any(line_words(docs(*rows, *rows[:5])).values())
    assert all(line_words(docs(*rows, *rows[:5], (99, f"{body(99)}\n{FOOTER}"))).values())
    # rows without an id are documents of their own
    assert all(r.n_line_words for r in quality.line_rules(docs(*rows, (None, f"{body(77)}\n{FOOTER}")), line_docs=20).collect())


def test_a_missing_host_is_no_empty_host(docs):
    half = [(i, f"{body(i)}\n{FOOTER}", "en", "" if i % 2 else None) for i in range(38)]
    assert not any(line_words(docs(*half)).values())
    assert sum(v > 0 for v in line_words(docs(*half, (100, f"{body(100)}\n{FOOTER}", "en", None))).values()) == 20
