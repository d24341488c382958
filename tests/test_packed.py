from contactweave.operators import packed as p

KNOWN = ["wine, beer and spirits shop", "bar & grill", "bakery", "hotel", "wholesale - paper goods", "children's club", "health and beauty shop"]


def cats(text):
    return p.Segmenter(p.SOFT_CATEGORY, KNOWN).split(text)


def test_categories():
    assert cats("bakery;hotel") == ["bakery", "hotel"]
    assert cats('["bakery","Wine, beer and spirits shop"]') == ["bakery", "Wine, beer and spirits shop"]
    assert cats("Wine, beer and spirits shop") == ["Wine, beer and spirits shop"]
    assert cats("Bar & grill, bakery / hotel") == ["Bar & grill", "bakery", "hotel"]
    assert cats("'bakery';hotel;;bakery ") == ["bakery", "hotel", "bakery"]
    assert cats("Wholesale - paper goods | Children's club") == ["Wholesale - paper goods", "Children's club"]
    assert cats("bakery\nnew trade") == ["bakery", "new trade"]
    assert cats("bakery and hotel") == ["bakery", "hotel"] and cats("Food and drink hall") == ["Food and drink hall"]
    assert cats("Tea & cake, hotel") == ["Tea & cake", "hotel"]
    assert cats(None) == [] and cats("") == [] and cats(" ; ") == [] and cats("[]") == []


def test_contacts():
    mail = p.Segmenter(p.SOFT_CONTACT, (), p.is_email)
    assert mail.split("a@b.example or c@d.test") == ["a@b.example", "c@d.test"]
    assert mail.split('"a@b.example"') == ["a@b.example"]
    assert mail.split("a@b.example  c@d.test;a@b.example") == ["a@b.example", "c@d.test", "a@b.example"]
    phone = p.Segmenter(p.SOFT_CONTACT, (), p.is_phone, p.may_be_phone)
    assert phone.split("+43 (0)555/92019") == ["+43 (0)555/92019"]
    assert phone.split("+32 555-97618 ext. 12 / 0044 555 02118") == ["+32 555-97618 ext. 12", "0044 555 02118"]
    assert phone.split("call us") == ["call us"]
    assert len(phone.split(";".join(["+4955501234"] * 5000))) == 5000


def test_listing_fields(spark):
    rows = [
        (1, "bakery;hotel", "a@b.example", "+4955501234;+4955501235"), (2, None, None, None), (3, "", " ", "n/a"), (4, "Bar & grill", "x@y.test, x@y.test", None),
        *[(10 + i, "Bar & grill", None, None) for i in range(5)],
    ]
    schema = "listing_id long, google_business_categories string, email string, phone_number string"
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in p.split_listing_fields(df.withColumn("val", df.email).withColumn("pos", df.listing_id)).collect()}
    assert got == {
        (1, "google_business_categories", 1, "bakery"), (1, "google_business_categories", 2, "hotel"), (1, "phone_number", 1, "+4955501234"),
        (1, "phone_number", 2, "+4955501235"), (4, "email", 1, "x@y.test"), (4, "email", 2, "x@y.test"),
    }
    assert p.split_listing_fields(spark.createDataFrame([], schema)).count() == 0


def test_known_values_come_from_the_automaton():
    """Without its hits, values that hold delimiters fall apart."""
    whole = p.Segmenter(p.SOFT_CATEGORY, KNOWN)
    assert whole.split("bakery, wine, beer and spirits shop / hotel") == ["bakery", "wine, beer and spirits shop", "hotel"]
    whole.automaton = None
    assert whole.split("bakery, wine, beer and spirits shop / hotel") == ["bakery", "wine", "beer and spirits shop", "hotel"]
    mail = p.Segmenter(p.SOFT_CONTACT, ["front desk"], p.is_email)
    assert mail.split("front desk a@b.example") == ["front desk", "a@b.example"]


def test_no_number_of_pieces_is_too_many():
    long = " ".join(f"word{i}" for i in range(3000))
    for shape, begins in ((p.is_email, p.never_longer), (p.is_phone, p.may_be_phone)):
        assert p.Segmenter(p.SOFT_CONTACT, (), shape, begins).split(long) == [long]
    many = ", ".join(f"trade {i}" for i in range(500))
    assert len(p.Segmenter(p.SOFT_CATEGORY, KNOWN).split(many)) == 500
    known = " & ".join(f"part{i}" for i in range(28))
    assert p.Segmenter(p.SOFT_CATEGORY, [known, "hotel"]).split(f"{known}, hotel") == [known, "hotel"]


def test_dictionaries_cover_all_fields(spark):
    rows = [(i, '"Wine, beer shop"' if i % 2 else "hotel;bar", "office@shop.example", "+43 (0)555/92019") for i in range(40)]
    df = spark.createDataFrame(rows, "listing_id long, google_business_categories string, email string, phone_number string")
    got = p.count_dictionaries(df, list(p.FIELDS))
    assert got == {"google_business_categories": ["bar", "hotel", "wine, beer shop"], "email": ["office@shop.example"], "phone_number": ["+43 (0)555/92019"]}
