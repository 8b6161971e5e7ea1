"""Types, labels and table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import is_blank

# Output types with placeholder and title, in legend order.
TYPES = [
    ("NAME", "NAME", "Names"),
    ("ORG", "ORG", "Schools & organizations"),
    ("EMAIL", "EMAIL", "Emails"),
    ("PHONE", "PHONE", "Phone numbers"),
    ("ADDRESS", "ADDRESS", "Street addresses"),
    ("CITY", "CITY", "Cities"),
    ("STATE", "STATE", "States & counties"),
    ("ZIP", "ZIP", "Zip codes"),
    ("DOB", "BIRTHDATE", "Birth dates"),
    ("DATE", "DATE", "Other dates"),
    ("AGE", "AGE", "Ages"),
    ("SSN", "SSN", "Social Security numbers"),
    ("ID", "ID", "ID & account numbers"),
    ("USERNAME", "USERNAME", "Usernames"),
    ("PASSWORD", "PASSWORD", "Passwords"),
    ("LINK", "LINK", "Links & online addresses"),
]

# The type that each label of a tagger makes; other labels make none.
LABEL_TYPE = {
    "FIRSTNAME": "NAME",
    "MIDDLENAME": "NAME",
    "LASTNAME": "NAME",
    "GIVENNAME": "NAME",
    "SURNAME": "NAME",
    "PREFIX": "NAME",
    "TITLE": "NAME",
    "COMPANYNAME": "ORG",
    "EMAIL": "EMAIL",
    "PHONENUMBER": "PHONE",
    "TELEPHONENUM": "PHONE",
    "STREET": "ADDRESS",
    "STREETADDRESS": "ADDRESS",
    "BUILDINGNUMBER": "ADDRESS",
    "BUILDINGNUM": "ADDRESS",
    "SECONDARYADDRESS": "ADDRESS",
    "CITY": "CITY",
    "STATE": "STATE",
    "COUNTY": "STATE",
    "ZIPCODE": "ZIP",
    "DOB": "DOB",
    "DATEOFBIRTH": "DOB",
    "DATE": "DATE",
    "AGE": "AGE",
    "SSN": "SSN",
    "SOCIALNUM": "SSN",
    "DRIVERLICENSENUM": "ID",
    "IDCARDNUM": "ID",
    "TAXNUM": "ID",
    "PASSPORTNUM": "ID",
    "ACCOUNTNUMBER": "ID",
    "ACCOUNTNUM": "ID",
    "CREDITCARDNUMBER": "ID",
    "CREDITCARDCVV": "ID",
    "IBAN": "ID",
    "BIC": "ID",
    "PIN": "ID",
    "MASKEDNUMBER": "ID",
    "VEHICLEVIN": "ID",
    "VEHICLEVRM": "ID",
    "PHONEIMEI": "ID",
    "USERNAME": "USERNAME",
    "ACCOUNTNAME": "USERNAME",
    "PASSWORD": "PASSWORD",
    "URL": "LINK",
    "IP": "LINK",
    "IPV4": "LINK",
    "IPV6": "LINK",
    "MAC": "LINK",
    "USERAGENT": "LINK",
    "BITCOINADDRESS": "LINK",
    "ETHEREUMADDRESS": "LINK",
    "LITECOINADDRESS": "LINK",
}

# Tokens of taggers that stand for no text.
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]", "<s>", "</s>", "<pad>", "<unk>", "<mask>"]
SCORE_THRESHOLD = 0.4
CHUNK_CHARS = 1300

FINDING = "struct<type: string, start: int, end: int, score: double, source: string>"
FINDINGS = f"array<{FINDING}>"


def types_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, p, n, i) for i, (t, p, n) in enumerate(TYPES)], "type string, ph string, title string, ord int")


def type_of(label: Column) -> Column:
    """The type of a tagger's label, with or without B- or I-; null for others."""
    pairs = [F.lit(x) for kv in sorted(LABEL_TYPE.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.regexp_replace(label, "^[BI]-", ""))


def placeholder(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for t, p, _ in TYPES for x in (t, p)]), kind)


def papers(docs: DataFrame) -> DataFrame:
    """documents as papers of one batch: paper_id, paper_ord, name, kind, text, status, error."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = is_blank(text)
    return docs.select(
        F.lit("corpus").alias("batch_id"), F.col("doc_id").cast("long").alias("paper_ord"), F.col("doc_id").cast("string").alias("paper_id"),
        F.concat("source", F.lit(".txt")).alias("name"), F.lit("text").alias("kind"), text.alias("text"),
        F.when(blank, "error").otherwise("done").alias("status"), F.when(blank, "file appears to be empty").alias("error"),
    )
