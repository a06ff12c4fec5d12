"""Pages written and labelled by hand, none made by the training templates: name -> (html, main text)."""

A = "The river had been rising since Tuesday, and by the weekend the lower meadows were under water."
B = "Farmers moved their cattle to the hills, while the council opened the school hall for those who had to leave their homes."
C = "Nobody was hurt."
D = "On Monday the first families went back, though the bridge at the mill stays closed until engineers have looked at its piers."
MENU = "<li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Contact us</a></li>"
CONSENT = "We use cookies to measure how our site is used, to show you adverts that fit your interests, and to remember your choices. You can change your mind at any time."


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


LAYOUTS = {
    "overlay_and_main": (f'<body><div class="gdpr-overlay"><p>{CONSENT}</p></div><main>{paragraphs(A, B, D)}</main></body>', [A, B, D]),
    "plain_with_short_end": (f"<html><body><h1>Floods</h1>{paragraphs(A, B, D, C)}</body></html>", ["Floods", A, B, D, C]),
    "table_with_menu_cell": (f"<table><tr><td class=menu><ul>{MENU}</ul></td><td>{paragraphs(A, B, C)}</td></tr></table>", [A, B, C]),
    "disqus": (f'<article><h1>Floods</h1>{paragraphs(A, B)}</article><div id="disqus_thread"><p>Great piece, we had the same thing here in March.</p><p>First!</p></div>', ["Floods", A, B]),
    "rail": (f'<div class="page"><div class="story">{paragraphs(A, B, D)}</div><div class="rail"><p><a href=/1>Ten towns to visit</a></p><p><a href=/2>What to cook now</a></p></div></div>', [A, B, D]),
    "wiki": (f'<div id="mw-navigation"><ul>{MENU}</ul></div><div id="content"><h1>Flood of 1911</h1><div class="mw-parser-output">{paragraphs(A, B, D)}</div></div><div id="footer"><ul><li><a href=/p>Privacy policy</a></li></ul></div>', ["Flood of 1911", A, B, D]),
    "bare_body": (f"<body>{paragraphs(A, B, D)}</body>", [A, B, D]),
    "nav_and_footer": (f"<nav><ul>{MENU}</ul></nav><article><h1>Floods</h1>{paragraphs(A, C, B)}</article><footer>© 2024 The Valley Post</footer>", ["Floods", A, C, B]),
    "div_soup": (f'<div class="w1"><div class="t"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class="x3"><h1>Floods</h1>{paragraphs(A, B, D)}</div><div class="b2"><a href=/p>Privacy</a> <a href=/t>Terms</a></div></div>', ["Floods", A, B, D]),
    "sidebar_first": (f'<div id="sidebar-left"><h3>Sections</h3><ul>{MENU}</ul></div><div id="main-content"><h1>Floods</h1>{paragraphs(A, B, C)}</div>', ["Floods", A, B, C]),
    "replies": (f'<main><h1>Floods</h1>{paragraphs(A, B, D)}</main><section id="replies"><h3>3 replies</h3><div class="reply"><p>I live by the mill and can only agree.</p></div><div class="reply"><p>Where can one give money?</p></div></section>', ["Floods", A, B, D]),
    "cookie_at_end": (f'<article>{paragraphs(A, B, D)}</article><div id="cookieConsent"><p>{CONSENT}</p><button>Accept</button></div>', [A, B, D]),
    "newsletter_inside": (f'<article><h1>Floods</h1>{paragraphs(A, B)}<div class="newsletter-signup"><p>Get our letter every morning.</p><form><input name=m><button>Sign up</button></form></div>{paragraphs(D)}</article>', ["Floods", A, B, D]),
    "related": (f'<article><h1>Floods</h1>{paragraphs(A, B, D)}</article><div class="related-stories"><h4>More on this</h4><ul><li><a href=/1>Rain to go on</a></li><li><a href=/2>Bridge shut</a></li></ul></div>', ["Floods", A, B, D]),
    "breadcrumbs": (f'<div class="breadcrumbs"><a href=/>Home</a> › <a href=/n>News</a></div><article><h1>Floods</h1>{paragraphs(A, B)}</article>', ["Floods", A, B]),
    "header_and_search": (f'<header><p>The Valley Post</p><form role="search"><input name=q><button>Search</button></form></header><main><h1>Floods</h1>{paragraphs(A, B, D)}</main>', ["Floods", A, B, D]),
    "list_inside": (f"<article><h1>Floods</h1>{paragraphs(A)}<ul><li>Keep to high ground.</li><li>Boil your water.</li></ul>{paragraphs(D)}</article>", ["Floods", A, "Keep to high ground.", "Boil your water.", D]),
    "quote_and_subhead": (f"<article><h1>Floods</h1>{paragraphs(A)}<h2>What comes next</h2><blockquote>{B}</blockquote>{paragraphs(D)}</article>", ["Floods", A, "What comes next", B, D]),
    "font_table_page": (f'<table width=760><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></td></tr><tr><td width=150><a href=/a>Archive</a><br><a href=/l>Links</a></td><td><font size=2>{paragraphs(A, B, D)}</font></td></tr></table>', [A, B, D]),
    "advert_between": (f'<div class="entry-content">{paragraphs(A)}<div class="ad-container"><p>Buy one lamp and get one free this week.</p></div>{paragraphs(B, D)}</div>', [A, B, D]),
    "script_and_style": (f"<head><style>p{{}}</style><script>var x = '<p>no</p>'</script></head><body><main>{paragraphs(A, B)}</main><script>track()</script></body>", [A, B]),
    "legal_foot": (f'<div class="post">{paragraphs(A, B, D)}</div><div class="legal"><p>Copyright 2024 Valley Media. All rights reserved.</p></div>', [A, B, D]),
    "share_bar": (f'<article><h1>Floods</h1><div class="share-tools"><a href=/f>Share</a> <a href=/m>Mail</a></div>{paragraphs(A, B, D)}</article>', ["Floods", A, B, D]),
    "comments_in_article": (f'<article><h1>Floods</h1>{paragraphs(A, B, D)}<div class="comments-area"><ol><li><p>My cellar is still full of mud, and nobody from the council has come.</p></li></ol></div></article>', ["Floods", A, B, D]),
}
