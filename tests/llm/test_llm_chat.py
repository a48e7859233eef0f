import brute
import pytest

from gradewright.llm import chat_format as chat
from llm_fixtures import clashing  # noqa: F401

SCHEMA = "conv_id long, turn long, role string, text string"


def test_template_language():
    render = chat.compile_template("{{ 'a' + 'b' }}-{% for x in xs %}{% if x.v == 1 or not x.ok %}[{{ x.n | upper }}]{% else %}{{ x.n }}{% endif %}{% endfor %}{% generation %}!{{ t }}{% endgeneration %}.")
    text, spans = render({"xs": [{"v": 1, "ok": True, "n": "p"}, {"v": 2, "ok": True, "n": "q"}, {"v": 3, "ok": False, "n": "r"}], "t": "yes"})
    assert text == "ab-[P]q[R]!yes." and [text[s:e] for s, e in spans] == ["!yes"]


def test_constants_are_folded():
    body = chat.fold_body(chat.Parser("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}{{ gone }}{% elif true and 'x' %}d{% else %}{{ gone }}{% endif %}{{ x }}").body()[0])
    assert body == (chat.Output(chat.Const("abCd")), chat.Output(chat.Name("x")))


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ open }}", "{{ x | eval }}", "{{ x( }}", "{% if x %}", "{% import os %}", "{{ 1 2 }}", "{{ }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)({"x": "text"})


@pytest.mark.parametrize("text", ["", "\\", "</s>", "[INST", "<\\.s>", "\\\\[INST]\\.", "a[[INST]]</s></s>", "ünï\n[/ROLE][TEXT]"])
def test_escape_is_reversible_and_breaks_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", None), (1, 0, "tool </s>", "a\\b [TEXT]"), (1, None, None, "first"),
            (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "x" * 200_000), (None, 0, "system", "no id")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = {-1: rows[:2], 1: [rows[4], rows[3], rows[2]], 2: [rows[7], rows[5], rows[6]], None: [rows[8]]}
    for conv, turns in order.items():
        learned = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), brute.sha(whole), len(learned), brute.sha(learned))
    formatted = {r.conv_id: r.formatted for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert formatted[-1] == "<s>[INST]<\\./s>[\\.INST] ok [\\./INST][/INST][BOT]<\\./s>[\\.INST] ok [\\./INST]</s>"
    assert {k: len(v) for k, v in formatted.items()} == {k: r.formatted_chars for k, r in got.items()}


def test_empty_and_clashing(spark, clashing):
    assert chat.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chat.report(clashing(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))).count() == 1
