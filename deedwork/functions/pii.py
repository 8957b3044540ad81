"""Personal data by value shape and by column name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whole-value shapes, in the order their labels are given.
VALUE_SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "phone": r"^[+]?[\d\s\-().]{7,}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "url": r"^(?i)https?://",
}

# What columns with such data are called. A name is cut into words where its letters and digits end; an entry is a word, or up to three words written
# together: "home_phone", "date of birth" and "zip-code" hold "phone", "dateofbirth" and "zipcode". The classes' names are fixed values, the lists are ours.
NAME_WORDS = {
    "address": {"address", "housenumber", "streetname", "street", "apartment", "postcode", "postalcode", "zipcode", "zip", "residence"},
    "credentials": {"password", "passphrase", "passcode", "pincode", "secret", "token", "apikey", "privatekey", "credentials", "otp"},
    "dob": {"dob", "birthday", "birthdate", "dateofbirth", "birthyear", "yearofbirth", "birthmonth", "placeofbirth"},
    "email": {"email", "emailaddress", "mailaddress", "mailbox"},
    "geo": {"latitude", "longitude", "lat", "lon", "lng", "geohash", "coordinates", "geolocation"},
    "ip_address": {"ip", "ipaddress", "clientip", "remoteip", "sourceip", "ipv4", "ipv6"},
    "mac_address": {"mac", "macaddress", "hardwareaddress"},
    "medical": {"diagnosis", "prescription", "medication", "allergy", "allergies", "bloodtype", "patientid", "patientnumber", "healthrecord"},
    "name": {"firstname", "lastname", "fullname", "surname", "forename", "givenname", "familyname", "middlename", "birthname", "nickname", "customername", "displayname"},
    "national_id": {"nationalid", "identitycard", "passport", "passportnumber", "taxid", "taxnumber", "driverslicense", "drivinglicence", "residencepermit"},
    "payment_card": {"cardnumber", "creditcard", "debitcard", "cardholder", "cvc", "cvv", "iban", "bankaccount", "accountnumber"},
    "phone": {"phone", "phonenumber", "telephone", "tel", "mobile", "mobilenumber", "cellphone", "fax"},
    "special_category": {"gender", "ethnicity", "religion", "disability", "sexualorientation", "politicalparty", "tradeunion", "maritalstatus"},
    "ssn": {"ssn", "socialsecurity", "socialsecuritynumber"},
    "username": {"username", "loginname", "login", "userhandle", "screenname"},
}
_MOST_WORDS = 3
# The more specific class on the left takes the general one on the right out.
MORE_SPECIFIC = {"email": "address", "ip_address": "address", "mac_address": "address", "username": "name"}


def name_classes(column: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", column.lower())
    spans = {"".join(words[i : i + n]) for n in range(1, _MOST_WORDS + 1) for i in range(len(words) - n + 1)}
    found = {label for label, known in NAME_WORDS.items() if known & spans}
    return sorted(found - {MORE_SPECIFIC[label] for label in found if label in MORE_SPECIFIC})


def luhn(value: Column) -> Column:
    """At least twelve digits whose Luhn sum ends in zero."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    counted = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
    )
    total = F.aggregate(counted, F.lit(0), lambda a, d: a + d)
    # Few values have that many digits; only theirs are taken apart.
    return F.when(F.length(digits) < 12, F.lit(False)).otherwise(total % 10 == 0)


def value_labels(value: Column) -> Column:
    """The labels of one value, as an array."""
    tests = [F.when(value.rlike(shape), F.lit(label)) for label, shape in VALUE_SHAPES.items()]
    tests.append(F.when(luhn(value), F.lit("credit_card")))
    return F.array_compact(F.array(*tests))


def could_be_labelled(value: Column) -> Column:
    """A cheap test no labelled value fails: it has a digit, an ``@`` or a web scheme."""
    return value.rlike(r"[0-9@]|^(?i)https?://|^[+]?[\s\-().]{7,}$")
