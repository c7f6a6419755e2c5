"""Definitions are checked when they are made."""

import json

import pytest

from fieldstone.catalog import (
    BOOL,
    FLOAT,
    INT,
    STRING,
    ArrayOf,
    Catalog,
    DefinitionError,
    Enumeration,
    Field,
    Model,
    Ref,
)
from fieldstone.sources.warehouse import CATALOG

KEY = Field("id", INT, 1, primary=True)


@pytest.mark.parametrize(
    "make",
    [
        lambda: Field("a", INT, 2, default="text"),
        lambda: Field("a", ArrayOf(INT), 2, default=[1, "two"]),
        lambda: Field("a", INT, 2, optional=True, default="text"),
        lambda: Field("a", BOOL, 2, default=1),
        lambda: Field("a", INT, 2, default=True),
        lambda: Field("a", INT, 0),
        lambda: Field("a", Enumeration("E", ("x",)), 2, default="y"),
        lambda: Field("a", FLOAT, 2, primary=True),
        lambda: Field("a", INT, 2, uuid=True),
        lambda: Field("a", STRING, 2, auto_increment=True),
        lambda: Field("a", ArrayOf(INT), 2, optional=True),
        lambda: ArrayOf(ArrayOf(INT)),
        lambda: Enumeration("E", ("x", "x")),
        lambda: Model("M", 1, (Field("a", INT, 2),)),
        lambda: Model("M", 1, (KEY, Field("a", INT, 2, primary=True))),
        lambda: Model("M", 1, (KEY, Field("a", INT, 1))),
        lambda: Model("M", 1, (KEY, Field("id", INT, 2))),
        lambda: Model("M", 0, (KEY,)),
        lambda: Model("M", 1, (KEY, Field("a", STRING, 2, public_credential=True))),
        lambda: Catalog((Model("M", 1, (KEY,)), Model("N", 1, (KEY,)))),
        lambda: Catalog((Model("M", 1, (KEY,)), Model("M", 2, (KEY,)))),
        lambda: Catalog((Model("M", 1, (KEY, Field("a", Ref("Nowhere"), 2))),)),
    ],
)
def test_refused(make):
    with pytest.raises(DefinitionError):
        make()


def test_accepted():
    Field("a", ArrayOf(INT), 2, default=[])
    Field("a", FLOAT, 2, default=1)
    Field("a", INT, 2, optional=True, default=None)


def test_history_form_round_trips():
    assert Catalog.from_dict(json.loads(json.dumps(CATALOG.to_dict()))) == CATALOG
