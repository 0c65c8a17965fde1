from jobloom.llm import quotations as q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq bigint, hash string"


def run(spark, rows):
    return q.conversations(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)).orderBy("conv_id", "position").collect()


def test_levels_and_passages():
    own, quoted = q.parse("Hi\nOn Monday Bob wrote:\n> On Sunday Al wrote:\n>> deep line\n> > deeper mark\n> his line\nBye > now\n")
    assert own == "Hi\nBye > now"
    assert [(n, b) for n, b in quoted] == [(2, "deep line\ndeeper mark"), (1, "his line")]
    assert q.parse(None) == ("", []) and q.parse("") == ("", [])


def test_links_replies_and_order(spark):
    rows = [(1, 0, "u", "How do I fix the printer?\nIt is broken."), (1, 1, "a", "> How do I fix the printer?\n\nTurn it off and on."),
            (1, 2, "u", "Bob wrote:\n>> How do I fix the printer?\n>> It is broken.\n> Turn it  OFF and on!\nThat works, thanks."),
            (1, 3, "a", "> nobody ever said such a thing\nok"), (1, 4, "u", "> How do I fix the printer?\n> It is broken.\nme too"),
            (2, 0, "u", "> How do I fix the printer?\nanother conversation")]
    out = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert [out[1, t].reply_to for t in range(5)] == [None, 0, 1, 2, 0]
    assert [out[1, t].by_quote for t in range(5)] == [False, True, True, False, True]
    assert (out[1, 2].n_quotes, out[1, 2].n_linked, out[1, 2].text) == (2, 2, "That works, thanks.")
    assert out[1, 3].text == "ok" and (out[2, 0].reply_to, out[2, 0].by_quote, out[2, 0].text) == (None, False, "another conversation")


def test_long_conversation_of_one_repeated_text(spark):
    rows = [(7, t, "u", "the very same message again") for t in range(400)] + [(7, 400, "a", "> the very same message again\nstop")]
    out = run(spark, rows)
    assert [r.position for r in out] == list(range(401)) and out[-1].reply_to == 0 and out[200].reply_to == 199


def test_edge_rows(spark):
    rows = [(None, 0, "u", None), (None, None, None, "first of a null turn"), (3, 1, "u", ""), (3, 1, "u", "same turn"), (3, 1, "u", "same turn"),
            (3, 2, "u", "> same turn\n" + "long " * 40_000), (4, 0, "u", ">" * 1000)]
    out = run(spark, rows)
    assert len(out) == 7 and out[0].text == "first of a null turn" and out[1].text == ""
    assert [r.position for r in out if r.conv_id == 3] == [0, 1, 2, 3]
    assert run(spark, []) == []


def test_against_all_message_pairs(spark):
    """Every quoted passage held against every message of its conversation, by plain comparison of normalised text."""
    import random
    import re
    rnd = random.Random(5)
    lines = [f"this is line number {i} of the talk" for i in range(14)] + ["ok", "short", "thanks a lot, really"]

    def norm(t):
        return re.sub(r"[\W_]+", " ", t.lower()).strip()

    def parts(t):
        every = [t, *re.split(r"\n\s*\n", t), *t.split("\n")]
        return list(dict.fromkeys(norm(p) for k, p in enumerate(every) if norm(p) and (k == 0 or len(norm(p)) >= q.LEAST_CHARS)))

    rows = []
    for conv in range(12):
        for turn in range(rnd.randint(1, 9)):
            body = [rnd.choice(lines) for _ in range(rnd.randint(1, 4))]
            old = [t for c, _, _, t in rows if c == conv]
            if old and rnd.random() < 0.7:
                source = rnd.choice(old).split("\n")
                body = [(">" * rnd.randint(1, 2) + " " + x.upper()) for x in source[:rnd.randint(1, len(source))] if not x.startswith(">")] + body
            rows.append((conv, turn, "u", "\n".join(body)))
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    linked = 0
    for conv, turn, _, text in rows:
        talk = sorted((t, parts(q.parse(x)[0])) for c, t, _, x in rows if c == conv)
        best, places = None, set()
        for place, (level, passage) in enumerate(q.parse(text)[1]):
            for rank, unit in enumerate(parts(passage)):
                first = next((t for t, units in talk if unit in units), None)
                if first is not None and first < turn:
                    places.add(place)
                    best = min(filter(None, [best, (level, rank, place, first)]))
        r = got[conv, turn]
        assert (r.by_quote, r.n_linked) == (best is not None, len(places))
        assert r.reply_to == (best[3] if best else turn - 1 if turn else None)
        linked += best is not None
    assert linked > 15
