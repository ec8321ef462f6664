import collections
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from glasswatch.llm import bpe, chat

from .helpers import SMALL, rows

SCHEMA = "conv_id long, turn long, role string, text string"


def expect(turns):
    by = collections.defaultdict(list)
    for t in turns:
        by[t[0]].append(t)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        out[conv] = (len(rs), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)), len(learned), sha(learned))
    return out


def check(spark, turns):
    got = chat.read_back(chat.assemble(chat.turns(spark.createDataFrame(turns, SCHEMA)))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expect(turns)
    return got


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    turns = [tuple(x[k] for k in ("conv_id", "turn", "role", "text")) for x in rows("conversations")]
    turns += [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    got = QUERIES["op6_chat_format"](spark, SMALL).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expect(turns)


def test_controls_in_texts_and_long_conversations(spark):
    turns = [(1, 0, "user", "a\\<s>b\\\\</s>\\"), (1, 1, "assistant", "<s>\\[INST]<\\s>[/ROLE]"), (1, 1, "assistant", ""), (1, None, None, None),
             (None, 3, "assistant", "é[ROLE]x"), (2, 0, "to[ROLE]ol\n", "[/INST]"), (2, 1, "", "x")]
    turns += [(3, k, "assistant" if k % 2 else "user", f"t{k}</s>") for k in range(1000)]
    check(spark, turns)
    pieces = chat.assemble(chat.turns(spark.createDataFrame(turns, SCHEMA))).where("conv = 3").orderBy("piece").collect()
    assert [r.piece for r in pieces] == [0, 1, 2, 3]
    whole = "".join(r.formatted for r in pieces)
    assert whole.count("</s>") == 500 and whole.count("[INST]") == 500  # only the template's own
    assert all(len(r.ids) == 4 * len(r.mask) for r in pieces)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<>/s[]INSTROLE\\ a", max_size=20), max_size=4))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(df["t"]).alias("e")).collect():
        assert chat.unescape(r.e) == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_empty(spark):
    assert check(spark, []) == []
    assert bpe.vocabulary().bytes and chat.FIRST_ID >= len(bpe.vocabulary().bytes)
