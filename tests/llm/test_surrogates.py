"""Surrogates: what stays together, what stays apart, and the forms that replacements keep."""

import re

from pyspark.sql import functions as F

from cellframe.llm import pii


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace(rows).orderBy("doc_id").collect()]


def rest(iban):
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned.replace(" ", ""))) % 97


def test_forms_and_coreference(spark):
    names, greek, phones, other, upper = replaced(
        spark,
        "Mr. John Smith and Mr Smith and Dr. Smith and Prof Anna Smith; Mr Paul Smith; Mr Jones",
        "Mr Παπαδόπουλος, κυρία Ελένη Παπαδόπουλος, Mr SMITH.",
        "+14155550123, +49 30 1234567, +1 415 555 0123, +353 1 234 5678, (415) 555-0123; at 12:30:45, 1 + 12345",
        "2001:db8::1 2001:DB8::1 fe80::1 2001:0db8:0000:0000:0000:ff00:0042:8329; GB82 WEST 1234 5698 7654 32 and GB00 WEST 1234 5698 7654 32; a::b std::max",
        "0123456789ABCDEF0123456789ABCDEF 0123456789abcdef0123456789abcdef",
    )
    for word in ("John", "Smith", "Jones", "Paul ", "Παπαδόπουλος", "SMITH", "4155550123", "1234567", "234 5678", "555-0123", "db8", "DB8", "WEST", "0123456789"):
        assert word not in names + greek + phones + other + upper
    found = re.match(r"Mr\. (\w+) (\w+) and Mr (\w+) and Dr\. (\w+) and Prof (\w+) (\w+); Mr (\w+) (\w+); Mr (\w+)$", names).groups()
    assert len({found[i] for i in (1, 2, 3, 5, 7)}) == 1 and found[8] != found[1]
    assert len({found[i] for i in (0, 4, 6)}) == 3
    first, given, second, shout = re.match(r"Mr (\w+), κυρία (\w+) (\w+), Mr (\w+)\.$", greek).groups()
    assert first == second and all("Ͱ" <= c <= "Ͽ" for c in (first + given).lower().replace("ά", "α"))
    assert shout == found[1].upper()
    german = re.match(r"\+1\d{10}, \+49 \d\d \d{7}, \+1 \d{3} \d{3} \d{4}, \+353 \d \d{3} \d{4}, \(\d{3}\) \d{3}-\d{4}; at 12:30:45, 1 \+ 12345$", phones)
    assert german and re.sub(r"\D", "", phones.split(", ")[0]) == re.sub(r"\D", "", phones.split(", ")[2])
    short, big, local, whole = other.split("; ")[0].split(" ")
    assert short.lower() == big.lower() and big.upper() == big and local.startswith("fe80::")
    assert re.match(r"2001(:[0-9a-f]{4}){7}$", whole) and re.match(r"2001:[0-9a-f]{3}::[0-9a-f]$", short)
    right, wrong = other.split("; ")[1].split(" and ")
    assert rest(right) == 1 and re.match(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d$", right) and re.match(r"GB\d\d [A-Z]{4}", wrong)
    assert other.endswith("; a::b std::max")
    assert upper.split()[0] == upper.split()[1].upper() and upper.split()[1] == upper.split()[1].lower()


def test_whole_names_of_one_family_stay_apart(spark):
    # far more given names than the list has, all of one family, which is a third of all mentions
    given = F.initcap(F.concat(F.lit("g"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr "), given, F.when(F.col("id") % 3 == 0, " Jones").otherwise(" Smith"), F.lit(" met Mr Smith")).alias("text"))
    got = [re.match(r"Mr (\w+) (\w+) met Mr (\w+)$", r.text).groups() for r in pii.replace(rows).orderBy("doc_id").collect()]
    assert len({g[:2] for g in got}) == 400
    assert len({g[2] for g in got}) == 1 and len({g[1] for g in got}) == 2
    assert all((g[1] == g[2]) == (n % 3 > 0) for n, g in enumerate(got))


def test_long_texts_ties_and_equal_documents(spark):
    one = "x " * 50_000 + "Dr Smith " * 200 + "y" * 100_000
    a, b, c = replaced(spark, one, one, "Dr Smith")
    assert a == b and a.count(c) == 200 and len(a) == len(one) + 200 * (len(c) - len("Dr Smith"))


def test_a_title_is_no_family_name(spark):
    (got,) = replaced(spark, "Mr Smith Mr Jones Dr Miller Mrs Mrsan")
    assert not re.search("Smith|Jones|Miller|Mrsan", got) and re.match(r"Mr \w+ Mr \w+ Dr \w+ Mrs \w+$", got)
