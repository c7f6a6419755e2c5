"""The country / citizen records that the golden cases start from."""

from fieldstone.catalog import FLOAT, INT, STRING, ArrayOf, Catalog, Field, Model, Ref
from fieldstone.sources.store import Store

COUNTRIES = Catalog(
    (
        Model(
            "Citizen",
            1,
            (Field("name", STRING, 1, primary=True), Field("home", Ref("Country"), 2, optional=True)),
        ),
        Model(
            "Country",
            2,
            (
                Field("code", STRING, 1, primary=True),
                Field("name", STRING, 2),
                Field("population", INT, 3, default=0),
                Field("gnp", FLOAT, 4, optional=True),
                Field("citizens", ArrayOf(Ref("Citizen")), 5),
                Field("cities", ArrayOf(STRING), 6),
            ),
        ),
    )
)


def countries(spark) -> Store:
    country = [
        ("KE", "Kenya", 5400, 113.0),
        ("PE", "Peru", 33000, 268.5),
        ("FJ", "Fiji", 930, 5.4),
        ("IS", "Iceland", 38, 31.0),
    ]
    return Store(
        spark,
        COUNTRIES,
        {
            "Country": spark.createDataFrame(country, COUNTRIES.struct("Country")),
            "Citizen": spark.createDataFrame([("Nuria", None), ("Bela", None)], COUNTRIES.struct("Citizen")),
        },
        {
            ("Country", "citizens"): spark.createDataFrame(
                [("PE", "Nuria"), ("KE", "Bela")], COUNTRIES.link_struct("Country", "citizens")
            )
        },
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
