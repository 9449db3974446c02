from merchlens.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob b", "Hello ä"), (1, 3, "ann", "Bye")]
    got = {r.perspective: r for r in chat.perspectives(turns(spark, rows)).collect()}
    assert set(got) == {"ann", "bob b"}
    ann = got["ann"]
    assert ann.rendered == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob_b\nHello ä<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [ann.rendered[s.start : s.stop] for s in ann.mask] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert ann.n_trained == len("HiBye") + 2 * len("<|im_end|>")
    bob = got["bob b"]
    assert [bob.rendered[s.start : s.stop] for s in bob.mask] == ["Hello ä<|im_end|>"]
    assert "<|im_start|>user name=ann\nHi" in bob.rendered


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(25)]
    whole = {r.perspective: r.rendered for r in chat.perspectives(turns(spark, rows)).collect()}
    parts = chat.perspectives(turns(spark, rows), turns_per_row=4).orderBy("perspective", "part").collect()
    assert [r.first_turn for r in parts if r.perspective == "a"] == [0, 4, 8, 12, 16, 20, 24]
    for who in "ab":
        assert "".join(r.rendered for r in parts if r.perspective == who) == whole[who]
    for r in parts:
        assert all(r.rendered[s.start : s.stop].startswith("turn ") for s in r.mask)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 2, "x", "hi"), (3, 0, "system", "alone"), (4, 1, "y", "tie"), (4, 1, "y", "tie")]
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(turns(spark, rows)).collect()}
    assert set(got) == {(None, "unknown"), (None, "x"), (4, "y")}
    assert got[4, "y"].n_turns == 2 and got[4, "y"].rendered.count("tie") == 2
    assert got[None, "x"].rendered.endswith("<|im_start|>user name=unknown\n<|im_end|>\n")
    assert chat.perspectives(turns(spark, [])).count() == 0
    extra = turns(spark, rows).withColumnRenamed("conv_id", "c").selectExpr("*", "1 as part", "2 as mask", "c as conv_id")
    assert chat.perspectives(extra).count() == 3
