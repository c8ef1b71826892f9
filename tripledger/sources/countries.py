"""The built-in country domain and its daily-allowance rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Country code, country name, allowance in EUR per day.
COUNTRY_RATES = """
AE|United Arab Emirates|120
AR|Argentina|75
AT|Austria|95
AU|Australia|115
BA|Bosnia and Herzegovina|65
BD|Bangladesh|40
BE|Belgium|95
BG|Bulgaria|70
BH|Bahrain|120
BR|Brazil|70
BY|Belarus|60
CA|Canada|105
CH|Switzerland|125
CL|Chile|80
CN|China|80
CO|Colombia|70
CR|Costa Rica|75
CZ|Czech Republic|80
DE|Germany|95
DK|Denmark|110
DO|Dominican Republic|85
DZ|Algeria|60
EC|Ecuador|65
EG|Egypt|55
ES|Spain|95
FI|Finland|110
FR|France|95
GB|United Kingdom|110
GR|Greece|85
GT|Guatemala|70
HR|Croatia|75
HU|Hungary|75
ID|Indonesia|60
IE|Ireland|100
IN|India|50
IT|Italy|95
JP|Japan|120
KE|Kenya|60
KR|South Korea|110
KZ|Kazakhstan|70
LK|Sri Lanka|50
LT|Lithuania|75
LU|Luxembourg|95
LV|Latvia|75
MA|Morocco|65
MC|Monaco|120
MM|Myanmar|50
MX|Mexico|80
MY|Malaysia|70
NG|Nigeria|60
NL|Netherlands|95
NO|Norway|115
NZ|New Zealand|115
OM|Oman|120
PA|Panama|75
PE|Peru|70
PH|Philippines|60
PK|Pakistan|50
PL|Poland|85
PT|Portugal|85
PY|Paraguay|70
RO|Romania|70
RS|Serbia|65
RU|Russia|85
SA|Saudi Arabia|120
SE|Sweden|90
SG|Singapore|120
SI|Slovenia|80
SK|Slovakia|80
TH|Thailand|70
TN|Tunisia|60
TR|Turkey|75
TW|Taiwan|110
US|United States|100
UY|Uruguay|80
VN|Vietnam|60
ZA|South Africa|70
"""

_ROWS = [line.split("|") for line in COUNTRY_RATES.strip().splitlines()]
COUNTRY_CODES = [code for code, _, _ in _ROWS]


def builtin_countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n) for c, n, _ in _ROWS], "code string, name string")


def builtin_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, float(rate)) for c, _, rate in _ROWS], "country string, daily_allowance double"
    )
