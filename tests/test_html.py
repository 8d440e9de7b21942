import pytest

from sieveworks.functions import html as H

CONTENT = [
    ("<article>a<article>b</article>tail</article><p>no</p>", "a b tail"),
    ('<div class="x post-content">one<div>in</div>two</div><main>m</main><section class="blog-post">s</section>', "one in two m s"),
    ("<main>m1</main><p>p</p><main>m2", "m1 m2"),
    ("<p>a <b>b</b></p><p>c", "ab c"),
    ("<!-- <article>x</article> --><script>'<article>'</script><p>y</p>", "y"),
    ("<article>&eacute; &#128512; &#38;lt; &#146; &amp;lt; &nosuch;</article>", "é \U0001F600 &lt; ’ &lt; &nosuch;"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,want", CONTENT)
def test_content(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(H.extract_content("h").alias("c")).first().c == want


def test_author_ends_at_its_own_close_tag(spark):
    html = '<div class="byline">By <div>Ann</div> Lee</div>'
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.extract_author("h", H.meta_tags("h")).alias("a")).first().a == "By Ann Lee"
