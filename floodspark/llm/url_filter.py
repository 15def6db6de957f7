"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Hosts, paths and rules are projections of built-in functions. Urls that no rule fits are judged by a
logistic regression over character n-grams (3 to 5) of host and path, trained on a small labelled
table of whole made-up urls, each with several signs, and of names without meaning; scoring needs no shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed unless the
model blocks an empty url; an empty path fits no rule, as rules' paths start with ``/``; of two rules of
one length the first in the table wins; a null page_id stays null; repeated rows repeat the result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_terms import Ftrl, sigmoid

BITS = 16
#: Fixed values: (host, path, verdict), as given.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The labelled table: made-up urls (host and path) of sites to block and to allow, none of them taken from a crawl.
BLOCKED_URLS = """
luckyspin-casino.net/free-spins/claim  royalcasinobonus.com/signup?aff=88  casino-jackpots777.biz/  playslots-online.info/win-big
megaslots.club/bonus/free-spins  pokerstake-win.net/deposit-bonus  texas-poker-cash.com/freeroll  roulette-winners.info/system/buy-now
bets365-free.biz/odds/claim-bonus  sportsbets-tips.net/free-bet  surebetting.win/promo/bets  livebetting-odds.club/join-now
bingo-cash-prize.com/win/free  lottowinners.biz/claim-prize  jackpot-lottery.win/ticket/free  blackjack-casino.bet/play-now
cheapviagra-pills.com/buy-now  pills-online.biz/cheap/viagra  cheapmeds-norx.net/order/pills  buy-cialis-cheap.info/discount
dietpills-fast.net/lose-weight/buy-now  steroids-shop.biz/order-cheap  xanax-norx.com/buy/pills  painkillers-cheap.info/no-prescription
miracle-weightloss-pills.com/free-trial  keto-diet-pills.info/free-trial/order  cheap-pharmacy-meds.biz/buy  hgh-steroids.net/cheap/order-now
xxx-videos-free.com/porn/watch  freeporn-tube.net/xxx  adultcams-live.com/nude/girls  hot-sex-cams.xxx/join-free
adult-dating-sex.net/signup-free  escorts-adult.club/girls/hot  nudegirls-cams.net/live/xxx  hentai-porn-xxx.info/free
sexchat-adults.com/join-now  adultxxx-movies.biz/watch/free-porn  hotmilf-dating.xxx/hookup/free  hookup-sex-tonight.com/join
crackedsoft-keygen.net/download/setup.exe  free-crack-keygen.com/photoshop/serial  warez-full.biz/download/crack.exe  nulled-scripts.club/free/download
torrent-movies-free.net/download/full  serial-keys-crack.info/windows/keygen  cracked-games-torrent.com/setup.exe  apk-mod-hack.net/free/unlimited-coins
hack-coins-free.club/generator/unlimited  game-cheats-hack.biz/generator/free-coins  activator-keygen.net/windows/crack  pirated-movies-hd.com/free/torrent
adserver-pop.com/click?id=991  ads-network-click.net/banner/728x90.gif  trackclicks.biz/pixel/track.gif  popunder-ads.info/serve/ads.js
clicktracker-ads.com/redirect?to=offer  banner-ads-serve.net/ads/728.gif  adtracking-pixel.com/track/click  pop-ads-media.biz/popunder.js
affiliate-clicks.net/go/aff123  track-offers.club/click/redirect  adclick-server.info/ads/click.php  pixel-trackers.com/track.gif
link-farm-seo.net/backlinks/buy  buy-backlinks-cheap.com/seo/links  spamlinks-directory.biz/submit/links  seo-spam-tools.net/mass/backlinks
email-spam-blaster.com/bulk/download  bulkmailer-spam.info/buy/list  articlefarm-spin.net/content/spam  spambot-forum-poster.biz/buy-now
followers-likes-buy.com/cheap/followers  buylikes-cheap.net/order/followers  cheap-traffic-clicks.com/buy/visitors  fake-reviews-buy.biz/order
payday-loans-fast.com/apply-now/cash  instantcash-loans.net/no-credit-check  get-rich-quick.biz/make-money/fast  makemoney-fast-home.com/free-system
binary-options-profit.net/signup-bonus  bitcoin-doubler-win.com/invest/profit  crypto-giveaway-free.net/claim  forex-profit-robot.biz/free-trial/buy-now
free-iphone-winner.com/claim-prize  winprizes-survey.net/claim/free  giftcard-giveaway-free.club/claim-now  you-won-prize.info/claim/winner
replica-watches-cheap.com/rolex/buy  fake-designer-bags.net/cheap/replica  cheap-replica-shop.biz/order-now  counterfeit-sneakers.club/discount/buy
secure-login-verify.net/account/update/password  paypa1-account-verify.com/login/confirm  bank-login-update.info/verify/account  appleid-locked-verify.net/login/unlock
antivirus-alert-scan.com/download/setup.exe  your-pc-infected.net/fix/download.exe  freescreensaver-toolbar.biz/install.exe  codec-update-player.com/download/install.exe
psychic-free-reading.com/call-now  singles-meet-hot.net/join-free  russian-brides-hot.com/girls/dating  mailorder-brides-cheap.info/girls
""".split()
ALLOWED_URLS = """
citylibrary.org/events/reading-hour  riverside-museum.org/exhibits/fossils  statearchive.gov/records/1890  nationalgallery.art/collection/landscape
weatheroffice.gov/forecast/north  mountain-rescue.org/report/avalanche  gardening-notes.net/roses/pruning  vegetablepatch.co.uk/tomatoes/sowing
familyrecipes.net/soups/lentil  breadbakers.org/sourdough/starter  slowcooking.blog/stew/beef  grandmas-kitchen.com/cakes/apple
history-of-rome.edu/lectures/12  openphysics.edu/mechanics/notes.pdf  mathworld-notes.org/algebra/groups  chemistrylab.edu/safety/gloves
primaryschool-hill.sch.uk/term-dates  university-press.edu/journals/history  teachers-forum.org/lessons/fractions  studentunion.ac.uk/clubs/chess
localtrains.co.uk/timetable/sunday  airporttransfers.net/terminal/2  cycling-routes.org/maps/coast  hikingtrails.org/lakes/day-walk
jazzarchive.org/albums/1959  choir-festival.net/programme  theatre-royal.co.uk/tickets/hamlet  cinemaclub.org/screenings/march
footballnews.net/league/results  villagecricket.org/fixtures  swimming-times.com/club/juniors  tennis-federation.org/rankings
townhall.gov/council/minutes/2021  healthservice.gov/vaccines/children  hospital-trust.nhs.uk/visiting  firebrigade.gov/safety/alarms
astronomyclub.org/telescopes/mirror  birdwatchers.net/sightings/heron  naturereserve.org/wetland/otters  geologymaps.gov/survey/sheet-14
poetrymagazine.org/issue/spring  bookreviews.net/novels/sea  shortstories.blog/winter/lighthouse  translationjournal.edu/volume/9
python-docs.dev/tutorial/loops  linuxhelp.org/wiki/permissions  databasenotes.dev/indexes/btree  opensource-forum.org/thread/3321
bicyclerepair.net/brakes/adjust  woodworkers.org/joints/dovetail  sewingpatterns.net/skirts/pleated  potterystudio.co.uk/glazes/blue
puppytraining.org/recall/steps  catcare.net/feeding/kittens  horseriding-school.co.uk/lessons  beekeepers.org/hives/winter
economics-review.edu/papers/trade  lawreports.gov/cases/2004/17  parliament.gov/debates/energy  census-data.gov/tables/housing
radio-news.net/world/elections  eveningpost.com/local/bridge  dailyherald.net/sport/rowing  sciencenews.org/article/volcano
language-courses.edu/spanish/verbs  dictionary-online.org/words/river  grammarguide.net/commas  learnfrench.org/lesson/4
photographyclub.org/gallery/night  paintingclasses.net/watercolour/sky  sculpture-park.org/visit/hours  architecture-week.net/bridges/steel
recycling-centre.gov/glass/opening  waterboard.gov/reservoirs/level  farmersmarket.org/stalls/saturday  seedbank.org/beans/heritage
oceanography.edu/tides/charts  sailingclub.net/regatta/results  lighthouse-trust.org/keepers  canalboats.co.uk/locks/guide
chessproblems.org/mate-in-two  boardgamers.net/rules/draughts  crossword-club.com/daily/7  quiznight.org/questions/geography
parishchurch.org/services/easter  charity-shop.org/donate/clothes  volunteers.org/rota/kitchen  scouts-group.org/camp/summer
careersadvice.gov/apprentices  smallbusiness.gov/tax/guide  insurance-guide.org/home/claims  pensions-office.gov/forms/12
hotel-seaview.com/rooms/double  campsite-pines.net/pitches  museumshop.org/posters/maps  bookshop-corner.co.uk/orders/track
""".split()
# Places and paths that tell nothing: each site of the table has some, so that both labels have them alike.
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info", ".co")
PATHS = ("/", "/index.html", "/page/12", "/en/4", "/2021/05/story.html", "/view/88", "/about", "/de/7731", "/fr/item", "/es/93.html")
#: Names without meaning, made of syllables: what tells nothing is to be allowed.
PLAIN_NAMES = 160
ALPHA, L1, EPOCHS = 0.5, 0.02, 20


def site_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) of the table's own urls: 1 is to be blocked."""
    out = []
    for label, urls in ((1, BLOCKED_URLS), (0, ALLOWED_URLS)):
        for url in urls:
            host, _, path = url.partition("/")
            out.append((host, "/" + re.split("[?#]", path)[0], label))
    return out


def with_plain_forms(sites: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The sites, and each twice more at a path and a place that tell nothing."""
    out = list(sites)
    for i, (host, _, label) in enumerate(sites):
        out.append((PREFIXES[i % 4] + host, PATHS[i * 7 % 10], label))
        out.append((PREFIXES[(i + 2) % 4] + host.rpartition(".")[0] + SUFFIXES[i % 3], PATHS[(i * 3 + 1) % 10], label))
    return out


def plain_urls() -> list[tuple[str, str, int]]:
    """Urls of names without meaning, all to be allowed."""
    rng, out = np.random.default_rng(41), []
    for i in range(PLAIN_NAMES):
        letters = [("bcdfghjklmnprstvwz"[c], "aeiou"[v]) for c, v in zip(rng.integers(18, size=4), rng.integers(5, size=4))]
        name = "".join(c + v for c, v in letters[: 2 + i % 3])
        out.append((PREFIXES[i % 4] + name + SUFFIXES[i // 4 % 5], PATHS[i * 7 % 10], 0))
    return out


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) of everything that the model learns from."""
    return with_plain_forms(site_urls()) + plain_urls()


def _digits(text: str) -> str:
    """``text`` with 0 for each digit: page numbers carry no weight."""
    return re.sub(r"\d", "0", text)


def url_terms(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams, each of its part and of either; digits are one class."""
    out = set()
    for kind, text in (("h", host), ("p", path)):
        text = f"^{_digits(text)}$"
        for gram in (text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)):
            out.update(crc32(f"{k}{gram}".encode()) & (1 << BITS) - 1 for k in (kind, "a"))
    return np.fromiter(sorted(out), np.int64, len(out))


def fit(table: list[tuple[str, str, int]] | None = None) -> tuple[float, np.ndarray]:
    """(bias, weights) learnt from ``table``, by default ``labelled_urls()``."""
    table = labelled_urls() if table is None else table
    model = Ftrl(bits=BITS, alpha=ALPHA, l1=L1).fit(
        [url_terms(h, p) for h, p, _ in table], np.array([y for _, _, y in table], float), epochs=EPOCHS
    )
    return model.bias, model.weights()


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later cases win: the longest comes last, and of one length the first of the table.
    for name, start, said in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


#: Scores that a task remembers: urls that differ in digits alone have one.
REMEMBERED = 100_000


def block_scores(model: tuple[float, np.ndarray], urls: Iterable[tuple[str, str]], known: dict | None = None) -> list[float]:
    """The model's probability of a block of each (host, path)."""
    bias, weights = model
    known = {} if known is None else known
    out = []
    for url in urls:
        key = _digits("\n".join(url))
        score = known.get(key)
        if score is None:
            if len(known) >= REMEMBERED:
                known.clear()
            score = known[key] = float(sigmoid(bias + weights[url_terms(*url)].sum()))
        out.append(score)
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the model's probability of a block."""
    shared = pages.sparkSession.sparkContext.broadcast(fit())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = block_scores(shared.value, zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = split.mapInArrow(scored, "page_id long, host string, path string, score double")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
