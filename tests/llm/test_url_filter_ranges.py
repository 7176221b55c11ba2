"""URL rules over ranges whose bounds Spark has to sample."""

import random

import pytest

from tablewright.llm import url_filter
from tests.llm.test_small_operators import judged


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rnd = random.Random(6)
    rules = [("block", f"d{i:03}.com", "/") for i in range(250)] + [("allow", f"d{i:03}.com", "/a/") for i in range(0, 250, 5)] + [("block", "com", "/x"), ("allow", "www.d007.com", "/a/b")]
    hosts = [f"d{i:03}.com" for i in range(300)] + [f"www.d{i:03}.com" for i in range(300)]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(('', 'a/', 'a/b/', 'x', 'p'))}{rnd.randrange(900)}" for _ in range(60_000)]
    urls += [f"https://h{i}.com/x" for i in range(30_000)]  # one key under com holds a third
    path = str(tmp_path_factory.mktemp("urls"))
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(16).write.parquet(f"{path}/t")
    return spark.read.parquet(f"{path}/t"), rules, urls


@pytest.mark.parametrize("parts", [4, 32, 200])
def test_rules_over_many_ranges(case, parts):
    pages, rules, urls = case
    host_rules = {}
    for rule in rules:
        host_rules.setdefault(rule[1], []).append(rule)

    def expected(url):  # only the rules that stand at some level of the host
        labels = url.split("/")[2].split(".")
        return judged(url, [r for i in range(len(labels)) for r in host_rules.get(".".join(labels[i:]), ())])

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.apply_url_rules(pages, rules, partitions=parts).collect()}
    wrong = [i for i, u in enumerate(urls) if got[i] != expected(u)]
    assert len(got) == len(urls) and not wrong, len(wrong)
