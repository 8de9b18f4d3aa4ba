"""URLs against the standard library's own judgement of their hosts."""

import ipaddress
from urllib.parse import urlparse

from pyspark.sql import functions as F

from quarrystone.functions import text as T

URLS = [
    "http://10.0.0.1/x", "=http://10.0.0.1/x", "==http://10.0.0.1/x", " http://10.0.0.1", " =http://10.0.0.1", "https://user:pw@192.168.1.9:8080/a b", "HTTP://172.31.255.255?x", "http://172.32.0.1", "http://8.8.8.8", "http://100.64.0.1",
    "http://192.0.0.9", "http://192.0.0.8", "http://192.0.0.170", "http://198.20.0.1", "http://198.19.9.9", "http://203.0.113.7", "http://240.0.0.1", "http://255.255.255.255", "http://224.0.0.1", "http://010.0.0.1", "http://10.0.0.256", "http://10.0.0",
    "http://[::1]/", "http://[::]/", "http://[2001:db8::1]:80/", "http://[2001:4860:4860::8888]/", "http://[fd00::1]", "http://[fe80::1]", "http://[fe80::1%25eth0]", "http://[fec0::1]", "http://[ff02::1]", "http://[2001::1]", "http://[2001:20::1]",
    "http://[2001:1::1]", "http://[2001:1::3]", "http://[2002:1::1]", "http://[3fff:0fff::1]", "http://[3fff:1000::1]", "http://[64:ff9b::1]", "http://[::ffff:10.0.0.1]", "http://[::ffff:8.8.8.8]", "http://[::8.8.8.8]", "http://[4000::1]", "http://[2600::]",
    "http://[1:2:3:4:5:6:7:8]", "http://[2600:2:3:4:5:6:7:8]", "http://localhost", "https://LOCALHOST:99/x", "http://a.local/x", "http://a.local.example", "http://example.com/10.0.0.1", "http://example.com@10.0.0.1/", "ftp://10.0.0.1", "10.0.0.1", "http://", "", "http:///x",
    "http://{{ $json.host }}/", "http://$env.HOST@10.0.0.1", "=https://10.1.2.3/{{x}}", "http://127.1", "http://0.0.0.0", "htt\tp://10.0.0.1", "see http://10.0.0.1",
]


def judged(url):
    if "{{" in url or "$env" in url:
        return False
    try:
        parsed = urlparse(url.lstrip("=").strip())
        host = (parsed.hostname or "").lower()
    except ValueError:
        return False
    if parsed.scheme not in ("http", "https") or not host:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return host in ("localhost", "localhost.localdomain") or host.endswith(".local")
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved


def test_hosts(spark):
    rows = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "url string").select("url", T.private_or_local(F.col("url")).alias("got")).collect()
    assert {r["url"]: r["got"] for r in rows if r["url"] is not None} == {u: judged(u) for u in URLS}
    assert [r["got"] for r in rows if r["url"] is None] == [False]


def test_every_network_edge(spark):
    """First and last address of each network, and their neighbours."""
    held = [ipaddress.ip_network(n) for n in (*T.INNER_4, *T.PUBLIC_4, *T.INNER_6, *T.PUBLIC_6)]
    found = {type(n.network_address)(int(n.network_address) + d) for n in held for d in (-1, 0, 1, n.num_addresses - 1, n.num_addresses) if 0 <= int(n.network_address) + d < 2**n.max_prefixlen}
    urls = [f"http://{a}/" if a.version == 4 else f"http://[{a}]/" for a in found]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", T.private_or_local(F.col("url")).alias("got")).collect()
    assert {r["url"]: r["got"] for r in rows} == {u: judged(u) for u in urls}
