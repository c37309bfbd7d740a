"""Regions that questions name (E1), as a membership table.

``(region, member)`` rows; a member is a country or another region, so a
region stands for all countries below it.  Pass your own table to the
operators for other groupings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Common regions and their members.
REGIONS = {
    "Asia": ["Central Asia", "East Asia", "South Asia", "Southeast Asia", "Western Asia"],
    "Central Asia": ["Kazakhstan", "Kyrgyzstan", "Tajikistan", "Turkmenistan", "Uzbekistan"],
    "East Asia": ["China", "Hong Kong", "Japan", "Macao", "Mongolia", "North Korea", "South Korea", "Taiwan"],
    "South Asia": ["Afghanistan", "Bangladesh", "Bhutan", "India", "Maldives", "Nepal", "Pakistan", "Sri Lanka"],
    "Southeast Asia": ["Brunei", "Cambodia", "Indonesia", "Laos", "Malaysia", "Myanmar", "Philippines", "Singapore",
                       "Thailand", "Timor-Leste", "Vietnam"],
    "Western Asia": ["Armenia", "Azerbaijan", "Cyprus", "Georgia", "Gulf States", "Iran", "Iraq", "Israel", "Jordan",
                     "Lebanon", "Palestine", "Syria", "Turkey", "Yemen"],
    "Gulf States": ["Bahrain", "Kuwait", "Oman", "Qatar", "Saudi Arabia", "United Arab Emirates"],
    "Middle East": ["Egypt", "Gulf States", "Iran", "Iraq", "Israel", "Jordan", "Lebanon", "Palestine", "Syria",
                    "Turkey", "Yemen"],
    "Latin America": ["Central America", "South America", "Mexico", "Cuba", "Dominican Republic", "Haiti"],
    "Central America": ["Belize", "Costa Rica", "El Salvador", "Guatemala", "Honduras", "Nicaragua", "Panama"],
    "South America": ["Argentina", "Bolivia", "Brazil", "Chile", "Colombia", "Ecuador", "Guyana", "Paraguay", "Peru",
                      "Suriname", "Uruguay", "Venezuela"],
    "North America": ["Canada", "Mexico", "United States"],
    "North Africa": ["Algeria", "Egypt", "Libya", "Morocco", "Sudan", "Tunisia"],
    "East Africa": ["Burundi", "Djibouti", "Eritrea", "Ethiopia", "Kenya", "Rwanda", "Somalia", "South Sudan",
                    "Tanzania", "Uganda"],
    "Southern Africa": ["Botswana", "Eswatini", "Lesotho", "Namibia", "South Africa", "Zambia", "Zimbabwe"],
    "Nordic Countries": ["Denmark", "Finland", "Iceland", "Norway", "Sweden"],
    "Baltic States": ["Estonia", "Latvia", "Lithuania"],
    "Benelux": ["Belgium", "Luxembourg", "Netherlands"],
}

# Other spellings of the regions above.
REGION_NAMES = [("South East Asia", "Southeast Asia"), ("South-Eastern Asia", "Southeast Asia"),
                ("Southern Asia", "South Asia"), ("Eastern Asia", "East Asia"), ("Northern Africa", "North Africa"),
                ("Eastern Africa", "East Africa"), ("Scandinavia", "Nordic Countries"), ("Baltics", "Baltic States")]


def regions_dim(spark: SparkSession) -> DataFrame:
    """(region, member) of the regions above; a spelling is a region whose one
    member is the region it spells."""
    rows = [(r, m) for r, ms in REGIONS.items() for m in ms] + REGION_NAMES
    return spark.createDataFrame(rows, "region string, member string")
