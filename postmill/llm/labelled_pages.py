"""Small labelled pages, written for this package, from which the weights of the content scan come.

Each line is (label, html): "c" for content that belongs into the clean text, "b" for what surrounds
it.  The pages are typical shapes: article, advert, listing, forum thread, page of help.
"""

PAGES = [
    [
        ("b", "<html><head><title>Careers</title><style>p{margin:0}</style><script>var a=1;</script></head><body>"),
        ("b", "<nav><ul><li><a href='/'>Home</a></li><li><a href='/jobs'>Jobs</a></li><li><a href='/login'>Sign in</a></li></ul></nav>"),
        ("c", "<h1>Warehouse associate</h1><p>You move goods between the docks and the shelves and keep the counts in order.</p>"),
        ("c", "<h2>Your profile</h2><ul><li>You work with care and like to be on your feet all day.</li><li>A forklift licence helps but we also train beginners.</li></ul>"),
        ("c", "<p>We pay overtime and offer <b>thirty days</b> of leave.<br/>Shifts are planned four weeks ahead.</p>"),
        ("b", "<footer><a href='/imprint'>Imprint</a> <a href='/privacy'>Privacy</a> <a href='/terms'>Terms</a></footer></body></html>"),
    ],
    [
        ("b", "<div><a href='#'>Share</a><a href='#'>Print</a><a href='#'>Save</a></div><form><input/><button>Search</button></form>"),
        ("c", "<h3>About the team</h3><p>The lab measures samples for clinics in the region. It has grown from five to twenty people since it was founded.</p>"),
        ("c", "<table><tr><th>shift</th><th>hours</th></tr><tr><td>early shift on weekdays</td><td>six to two</td></tr></table>"),
        ("c", "<p>Send us a short letter about yourself, your certificates and the date from which you could start.</p>"),
        ("b", "<aside><h4>More jobs</h4><ul><li><a href='/1'>Nurse</a></li><li><a href='/2'>Driver</a></li><li><a href='/3'>Cook</a></li></ul></aside>"),
    ],
    [
        ("b", "<header><img/><a href='/'>Logo</a><select><option>EN</option><option>DE</option></select></header>"),
        ("c", "<article><h2>How to write a letter</h2><p>Begin with the reason why you write. Say what you have done before and what you want to learn.</p>"),
        ("c", "<blockquote>Keep it to one page and read it aloud before you send it.</blockquote><pre><code>Dear team, I saw your advert and would like to apply.</code></pre>"),
        ("c", "<p>A table of dates helps the reader, and <em>plain words</em> help even more than a long list of skills does.</p></article>"),
        ("b", "<div><button>Like</button><a href='#'>Reply</a><a href='#'>Report</a></div><iframe></iframe><noscript>Enable scripts</noscript>"),
        ("b", "<footer><ul><li><a href='/a'>About</a></li><li><a href='/b'>Contact</a></li><li><a href='/c'>Help</a></li></ul></footer>"),
    ],
    [
        ("b", "<section><a href='/x'>Accept cookies</a><a href='/y'>Settings</a></section>"),
        ("c", "<p>The office is close to the station and has a quiet room, a canteen and space for bicycles in the yard behind it.</p>"),
        ("c", "<ol><li>Fill in the form on the portal.</li><li>Wait for the mail with a date.</li><li>Bring your papers to the first talk.</li></ol>"),
        ("c", "<div>Cost is bounded by <sub>n</sub> in the usual case and by <sup>two</sup> in the worst one, as the note in the annex says.</div>"),
        ("b", "<script>track()</script><a href='/prev'>Back</a><a href='/next'>Next</a>"),
    ],
]

#: Small labelled texts, written for this package: the kinds of markup that each has, and the text.  Those
#: without a kind use the signs of markup in the way that prose does.
TEXTS = [
    ("html", "<p>You plan the shifts of the ward.</p><p>You train new people.</p>"), ("html", "First line<br>second line<br/>third line"), ("html", "Bring <b>boots</b> and a coat"),
    ("html", "&lt;ul&gt;&lt;li&gt;early shift&lt;/li&gt;&lt;/ul&gt;"), ("html", "Sales &amp; service in one team"), ("html", "Ten&nbsp;days of leave &#8211; at least"), ("html", "<!-- draft --> The office is near the station"),
    ("html", "<div class='x'><h2>Who we are</h2> A small workshop"), ("html", "we bake <o:p></o:p> and deliver"), ("html", "&amp;lt;p&amp;gt;Twice escaped&amp;lt;/p&amp;gt;"), ("html", "the end of a list</li></ul>"), ("html", "<?xml version='1.0'?> a note"),
    ("markdown", "## What we offer\n\nA desk by the window"), ("markdown", "The **head cook** decides"), ("markdown", "It is *quite* simple"), ("markdown", "It is _quite_ simple"), ("markdown", "Read [the guide](https://guide.test) first"),
    ("markdown", "Run `make all` every night"), ("markdown", "```\nmake all\n```"), ("markdown", "- bread\n- milk\n- eggs"), ("markdown", "1. wash\n2. dry\n3. fold"), ("markdown", "~~closed~~ open"), ("markdown", "> we said so\n\nand meant it"),
    ("markdown", "Title of it\n=====\n\ntext"), ("markdown", "Part one\n\n---\n\npart two\n---"), ("markdown", "| day | hours |\n|-----|-------|\n| Mon | 8 |"), ("markdown", "__Bold__ claim and ![a plan](plan.png)"), ("markdown", "### Tasks\n\n* lift\n* carry"),
    ("wiki", "== Tasks ==\n*lift\n*carry"), ("wiki", "A '''bold''' claim"), ("wiki", "A ''quiet'' place"), ("wiki", "See [[Main page|the start]]"), ("wiki", "See [[Harbour]] for more"), ("wiki", "Ask [https://guide.test the guide] first"),
    ("wiki", "{{note|closed on Monday}}"), ("wiki", "{| class=x\n|-\n| Mon || 8\n|}"), ("wiki", "=== Hours ===\n#first\n#second"),
    ("latex", "\\section*{Tasks}\n\\begin{itemize}\n\\item lift\n\\end{itemize}"), ("latex", "The \\textbf{head cook} decides"), ("latex", "Costs grow like $n^{2}$ at most"), ("latex", "$$ a_1 + a_2 = b $$"), ("latex", "so \\(k \\geq 3\\) holds"),
    ("latex", "\\[ x = \\frac{1}{2} \\]"), ("latex", "first \\\\ second"), ("latex", "45\\% of all \\& more \\ldots{} to come"), ("latex", "$\\sum_i w_i$ is one"),
    ("", "We were voted #1 twice, write C# and F#, and ticket #3451 is ours"), ("", "Latency < 5 ms and uptime > 99 %, 3 <x and y> 4"), ("", "Rooms of 5 * 7 m, 4*4 drive, and a 5* hotel"), ("", "the weekly_team_report and snake_case_names"),
    ("", "From $ 47k to $ 66k, US$20-$30, and $5 a day"), ("", "R&D, AT&T, Smith & Sons, Q&A"), ("", "[hybrid roles only] and notes [1] or [see below]"), ("", "x^2 grows, c_1 and ~45 % more"), ("", "• first\n• second\n– third"),
    ("", "a - b, nine - five, well-known; 9-5 | 8-4"), ("", "don't, o'clock, 'quoted' and ''"), ("", "mail <ann@x.test> or <Acme>"), ("", "C:\\temp\\new and and/or \\ backslash"), ("", "a == b, x = 3, ==> next"), ("", "Plain words, nothing else; a colon: and (brackets) {braces} too"),
    ("", "Room [A] and [B], desks [1-4] and [all notes]"), ("", "it's the owners' choice, isn't it"), ("", "if a == b then c == d"), ("", "costs $3 or $ 45 and 2^8 units"), ("markdown", "it's [a list](x.md) with owners' names"),
    ("latex", "it's $x_1$ in [all notes]"), ("html", "it's <i>here</i> [1]"), ("", "We plan the shifts of the ward and train new people in the first weeks"), ("", "The team is small. It keeps the machines of the plant running day and night"), ("", "Call us on Monday at 8:30 or write a short letter about yourself"),
]
