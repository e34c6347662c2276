"""Record types and fixed values of the archive."""

from pyspark.sql import types as T

BOOKMARK = T.StructType([T.StructField(c, T.StringType()) for c in ("URL", "Title", "Selection", "Folder", "Timestamp", "Tags")])
ARTICLE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("tags", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()), T.StructField("content", T.StringType()), T.StructField("word_count", T.LongType()),
])
PENDING, SUCCESS, ARCHIVED, FAILED = "pending", "success", "archived", "failed"
LOCAL_ZONE = "America/Los_Angeles"
MAX_BODY = 50 * 1024 * 1024

# Hosts known to ask for payment.
PAYWALLED = """
bbc.com reuters.com nytimes.com washingtonpost.com
adweek.com americanaffairsjournal.org barrons.com benzinga.com bloomberg.com businessinsider.com citywire.com cnbc.com
entrepreneur.com fastcompany.com forbes.com fortune.com hbr.org inc.com marketwatch.com sloanreview.mit.edu mnimarkets.com
qz.com spglobal.com stocknews.com bizjournals.com businessoffashion.com wsj.com voguebusiness.com
brill.com thebulletin.org cen.acs.org discovermagazine.com historytoday.com insidehighered.com interestingengineering.com
medscape.com technologyreview.com nationalgeographic.com nature.com nautil.us newscientist.com popsci.com science.org
sciencenews.org scientificamerican.com statnews.com the-scientist.com timeshighereducation.com
ft.com economist.com telegraph.co.uk thetimes.com spectator.co.uk independent.co.uk theguardian.com bbc.co.uk
lemonde.fr lefigaro.fr spiegel.de zeit.de corriere.it elpais.com lavanguardia.com
nzherald.co.nz theaustralian.com.au smh.com.au theage.com.au
scmp.com nikkei.com japantimes.co.jp thehindu.com indianexpress.com
lanacion.com.ar clarin.com folha.uol.com.br elmercurio.com eltiempo.com
""".split()

# Title words that are not counted.
STOP_WORDS = ["with", "from", "that", "this", "your", "github", "page", "home", "about", "blog", "news", "site", "article"]
