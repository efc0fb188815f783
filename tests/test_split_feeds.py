"""One large feed file, several tasks."""

from brightshelf.sources import feeds
from brightshelf.streaming.counters import setting

HEAD = '<yml_catalog><shop><name>S</name><categories><category id="1">Phones</category><category id="2" parentId="1">Cases &amp; more</category><category id="3"/></categories><offers>'


def offer(k):
    return f"""<offer id="{k}" available="{'true' if k % 3 else 'false'}"><name>One &amp;quot;x&amp;quot; {k} Ж</name><price>{k}.5</price><categoryId>{1 + k % 2}</categoryId><picture>p1</picture><picture>p2</picture>
<param name="c>d">red</param><param name="c>d">blue</param></offer>{'<offer id="e%d" available="x/y>z"/>' % k if k % 50 == 0 else ''}"""


def write(tmp_path, name, offers):
    path = tmp_path / name
    path.write_text(HEAD + "\n".join(offers) + "</offers></shop></yml_catalog>\n")
    return str(path)


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in df.columns) for r in df.collect())


def test_a_file_in_splits(spark, tmp_path):
    path = write(tmp_path, "f.xml", [offer(k) for k in range(600)])
    want = rows_of(feeds.read_yml(spark, path))
    assert len(want) == 612
    with setting(spark, "spark.sql.files.maxPartitionBytes", "16k"), setting(spark, "spark.sql.files.openCostInBytes", "0"):
        split = feeds.elements(spark, path, "offer")
        assert split.rdd.getNumPartitions() > 5 and split.count() == 612
        assert rows_of(feeds.read_yml_split(spark, path)) == want


def test_files_that_cannot_be_split(spark, tmp_path):
    section = '<offer id="s"><name><![CDATA[a </offer> b]]></name><price>1</price></offer>'
    comment = '<!-- <offer id="no"><name>x</name></offer> -->'
    for name, odd in (("s.xml", section), ("c.xml", comment)):
        path = write(tmp_path, name, [offer(1), odd, offer(2)])
        assert not feeds.splittable(spark, path, "offer")
        assert rows_of(feeds.read_yml_split(spark, path)) == rows_of(feeds.read_yml(spark, path))
    path = write(tmp_path, "ok.xml", [offer(1), '<offer id="t"><name><![CDATA[a <b> b]]></name><price>1</price></offer>'])
    assert feeds.splittable(spark, path, "offer") and rows_of(feeds.read_yml_split(spark, path)) == rows_of(feeds.read_yml(spark, path))
    (tmp_path / "none.xml").write_text("")
    assert feeds.read_yml_split(spark, str(tmp_path / "none.xml")).collect() == []
