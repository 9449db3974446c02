"""Cleaning and search-text literals."""

from pyspark.sql import functions as F

from merchlens.functions import text as tx


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


def test_clean_text(spark):
    assert one(spark, "  A &amp; B <b>bold</b> x\u0007 ", tx.clean_text) == "A & B bold x"
    assert one(spark, "ﬁne １２", tx.clean_text) == "fine 12"
    assert one(spark, "None", tx.clean_text) is None
    assert one(spark, "plain", tx.clean_text) == "plain"


def test_clean_price(spark):
    values = {"379.0": 379.0, "0": None, "-5": None, "abc": None, "nan": None, "Infinity": None, "12.345": 12.35, None: None}
    for raw, want in values.items():
        assert one(spark, raw, tx.clean_price) == want


def test_rating(spark):
    df = spark.createDataFrame([("4.5", None), ("No rating available", "3"), ("6", "0.5"), (None, " 5 ")], "a string, b string")
    got = [r[0] for r in df.select(tx.normalize_rating(F.col("a"), F.col("b"))).collect()]
    assert got == [4.5, 3.0, None, 5.0]


def test_specifications(spark):
    raw = r'{"product_specification"=>[{"key"=>"RAM", "value"=>"16GB"}, {"key"=>"Say \"hi\"", "value"=>nil}, {"key"=>"Count", "value"=>3}, {"key"=>"ram", "value"=>"8GB"}]}'
    got = [tuple(r) for r in one(spark, raw, tx.parse_specifications)]
    assert got == [("RAM", "16GB"), ('Say "hi"', None), ("Count", "3"), ("ram", "8GB")]
    assert one(spark, raw, lambda c: tx.specs_map(tx.parse_specifications(c))) == {"ram": "8gb", "count": "3"}
    assert one(spark, '{"product_specification"=>nil}', tx.parse_specifications) == []
    assert one(spark, raw, lambda c: tx.format_specifications(tx.parse_specifications(c))) == "RAM: 16GB; Count: 3; ram: 8GB"


def test_category_levels(spark):
    cases = {
        '["Clothing >> Women >> Tops"]': ["Clothing", "Women", "Tops"],
        "['A >> B']": ["A", "B"],
        "[\"\"]": [],
        "[]": [],
        "Footwear >>  >> Shoes": ["Footwear", "Shoes"],
        None: [],
    }
    for raw, want in cases.items():
        assert one(spark, raw, tx.category_levels) == want, raw
    assert one(spark, '["X >> Y"]', lambda c: tx.category_level(c, 3)) is None


def test_truncate(spark):
    assert one(spark, "alpha beta gamma", lambda c: tx.truncate_description(c, 12)) == "alpha beta"
    assert one(spark, "alpha beta gamma", lambda c: tx.truncate_description(c, 10)) == "alpha beta"
    assert one(spark, "abcdefghij", lambda c: tx.truncate_description(c, 4)) == "abcd"
    assert one(spark, "N/A", tx.truncate_description) is None


def test_search_text(spark):
    df = spark.createDataFrame(
        [("Lamp", "Home", "none", [("Color", "Red"), ("Size", "NA")], "Nice  lamp"), (None, "Home", "B", [], "x")],
        "n string, c string, b string, s array<struct<key:string,value:string>>, d string",
    )
    got = [r[0] for r in df.select(tx.search_text(*[F.col(c) for c in "ncbsd"])).collect()]
    assert got == ["Product: Lamp | Category: Home | Specifications: Color: Red | Description: Nice lamp", None]
    assert one(spark, "Product: A | Category: B | Brand: None", tx.search_text_problem) == "placeholder: Brand: None"
    assert one(spark, "Product: A | Category: B", tx.search_text_problem) is None
    assert one(spark, "A | Category: B", tx.search_text_problem) == "no product prefix"


def test_urls(spark):
    assert one(spark, " HTTPS://a.b/c ", tx.sanitize_url) == "HTTPS://a.b/c"
    assert one(spark, "ftp://a.b", tx.sanitize_url) is None
    assert one(spark, "http:///x", tx.sanitize_url) is None
    assert one(spark, '["bad", "http://i.com/1.jpg"]', tx.first_url) == "http://i.com/1.jpg"


def test_boilerplate_and_match_key(spark):
    raw = "Great mug. Free Shipping. Cash On Delivery! 30 Day Replacement Guarantee. Enjoy."
    assert one(spark, raw, tx.strip_boilerplate) == "Great mug. Enjoy."
    garbled = "dưới".encode("utf-8").decode("latin-1")
    assert one(spark, garbled, tx.match_key) == "dưới"
    assert one(spark, "Café", tx.match_key) == "café"
    assert one(spark, "ÂB", tx.match_key) == "âb"
