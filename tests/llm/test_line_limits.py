"""What line windows leave: defined, so that it isn't taken for found."""

from weftline.llm import linededup


def test_a_passage_inside_different_lines_stays(frame):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [f"here begins {passage} one end", f"other start {passage} another end", passage, f"top\n{passage}\nend", f"top\n{passage}\nother end"]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(texts)).collect()}
    assert [got[i] for i in range(5)] == texts


def test_a_passage_of_three_lines_goes(frame):
    passage = "\n".join(" ".join(f"word{k}{i}" for i in range(20)) for k in range(3))
    texts = [passage, f"top\n{passage}\nend"]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(texts)).collect()}
    assert got == {0: passage, 1: "top\nend"}
