from maskwright.llm.html_extract import main_text

LONG = "Plain words of the article that go on and on for a while. " * 6


def test_hints_are_only_a_prior():
    for attrs in ("class='layout has-sidebar'", "class='page no-sidebar'", "class=sidebar"):
        page = f"<body><div {attrs}><article><h2 id=related-work>Related work</h2><p>{LONG}</p><div class=ad>Buy this</div></article></div></body>"
        assert main_text(page) == f"Related work\n{LONG.strip()}"
    for name in ("related-work", "social-impact", "side-by-side", "search-results", "legal"):
        page = f"<body><article><p>{LONG}</p><section id={name}><h2>Title</h2><p>Short text</p></section></article></body>"
        assert main_text(page).endswith("Title\nShort text")
    assert main_text(f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div></form></body>").count("Plain") == 12
