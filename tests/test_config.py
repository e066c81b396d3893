import pytest

from logfold.sources import config


def test_hosts():
    text = '{"version": 1, "repositories": [{"id": "b", "location": "/b", "scrub_interval": "1h"}, {"id": "a"}]}'
    a, b = config.load_hosts(text)
    assert (a.id, b.id, b.scrub_interval) == ("a", "b", 3600 * 10**9)
    for bad in (text + "x", text.replace("1,", "2,", 1), '{"version": 1, "repositories": []}', text.replace('"location"', '"place"'), text.replace('"a"', '"b"'), text.replace('"a"', '"../a"'), text.replace("1h", "-1h"), '{"version": 1, "version": 1}'):
        with pytest.raises(ValueError):
            config.load_hosts(bad)


def test_grants(spark):
    digest = "a" * 64
    text = '{"version": 1, "repositories": {"r": [{"name": "x", "sha256": "%s", "read": true}]}}' % digest
    assert [tuple(r) for r in config.load_grants(spark, text).collect()] == [("r", "x", digest, True, False)]
    for bad in (text.replace(digest, "A" * 64), text.replace('"read"', '"reads"')):
        with pytest.raises(ValueError):
            config.load_grants(spark, bad)


def test_retention_and_durability():
    assert config.retention_policy("25h") == (2, "COMPLIANCE") and config.retention_policy("24h", " governance ") == (1, "GOVERNANCE")
    for bad in (("",), ("1h", "x")):
        with pytest.raises(ValueError):
            config.retention_policy(*bad)
    assert config.durability("/a") == "single" and config.durability("/a", "file:///b") == "dual"
    for bad in (("/a", "file:///a/"), ("/a", "", True)):
        with pytest.raises(ValueError):
            config.durability(*bad)
