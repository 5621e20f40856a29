"""The digests of the trained text come from the loss mask, so a wrong mask shows."""

from pyspark.sql import functions as F

from pairwell.llm import chat


def test_digests_follow_the_mask(spark):
    rows = [(1, 0, "user", "hé <|q"), (1, 1, "assistant", "a\\b <|x"), (1, 2, "assistant", "é!"), (2, 0, "user", "only")]
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    loss = lambda df: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(df).collect()}
    right = loss(formatted)
    assert right[1][0] == len("a\\b <|x" + "é!") and right[2][0] == 0
    flipped = F.transform("mask", lambda x: F.struct(x["chars"].alias("chars"), (~x["loss"]).alias("loss")))
    wrong = loss(formatted.withColumn("mask", flipped))
    assert wrong[1] != right[1] and wrong[2][0] == len("<|im_start|>user\nonly<|im_end|>\n")
