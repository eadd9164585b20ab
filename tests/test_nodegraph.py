"""Products and businesses said by several JSON-LD nodes."""

import json

import pytest

from webloom.operators import modules, nodegraph


def page(*blocks):
    return "<body>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + "</body>"


APART = {"@context": "https://schema.org", "@graph": [
    {"@type": "Product", "@id": "#p", "name": "Lamp", "offers": {"@id": "#all"}, "brand": {"@id": "#b"}}, {"@type": "AggregateOffer", "@id": "#all", "offers": [{"@id": "#o1"}, {"@type": "Offer", "price": "7", "priceCurrency": "EUR"}]},
    {"@type": "Offer", "@id": "#o1", "price": 5, "priceCurrency": "EUR"}, {"@type": "Brand", "@id": "#b", "name": "Lights"}, {"@type": "Product", "@id": "#q", "name": "Bare", "isRelatedTo": {"@id": "#gone"}},
]}
INVERSE = [{"@type": ["Thing", "Product"], "@id": "x"}, {"@type": "Offer", "price": 3, "itemOffered": {"@id": "x"}}]
TWICE = ({"@type": "Product", "@id": "t", "name": "T"}, {"@id": "t", "offers": {"@type": "Offer", "price": 1}, "brand": "B"})
LOOP = [{"@type": "Product", "@id": "a", "name": "A", "offers": {"@id": "b"}}, {"@type": "Offer", "@id": "b", "offers": {"@id": "a"}}]
SHOP = {"@graph": [{"@type": "Store", "@id": "s", "name": "S", "telephone": "1", "address": {"@id": "ad"}}, {"@type": "PostalAddress", "@id": "ad", "postalCode": "7"}, {"@type": "Dentist", "name": "D"}]}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, page(APART)), (2, page(INVERSE)), (3, page(*TWICE)), (4, page(LOOP, "{broken")), (5, page(SHOP)), (6, None), (7, "no markup")]
    return spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in rows], "page_id long, url string, html string")


def test_products_through_nodes_of_their_own(spark, pages):
    got = {(r["page_id"], r["product"]): r for r in nodegraph.products(pages).collect()}
    assert set(got) == {(1, "#p"), (1, "#q"), (2, "x"), (3, "t"), (4, "a")}
    lamp = got[1, "#p"]
    assert (lamp["name"], lamp["brand"], lamp["prices"], lamp["currencies"], lamp["valid"], lamp["missing"]) == ("Lamp", "Lights", ["5", "7"], ["EUR"], True, 0)
    assert not got[1, "#q"]["valid"] and got[1, "#q"]["missing"] == 1
    assert got[2, "x"]["prices"] == ["3"] and not got[2, "x"]["valid"]  # no name
    assert got[3, "t"]["valid"] and got[3, "t"]["brand"] == "B" and got[4, "a"]["valid"]


def test_businesses(spark, pages):
    assert {(r["page_id"], r["complete"]) for r in nodegraph.businesses(pages).collect()} == {(5, True), (5, False)}


def test_modules_read_the_graph(spark, pages):
    rows = {(r["page_id"], r["module"]): r["points"] for r in modules.evaluate(nodegraph.with_graph(pages), ["ecommerce", "local_seo"]).collect()}
    assert rows[1, "ecommerce"]["product_schema"] == 25 and rows[1, "ecommerce"]["schema_valid"] == 15 and rows[2, "ecommerce"]["schema_valid"] == 0
    assert rows[5, "local_seo"]["local_business_schema"] == 20 and rows[5, "local_seo"]["nap_in_schema"] == 15 and rows[7, "local_seo"]["nap_in_schema"] == 0
    assert nodegraph.products(pages.limit(0)).count() == 0
