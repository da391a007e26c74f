"""The text passes of problem 10 on the JVM: list material of a page, and the shingles of the whole page.

``p10_stuffing.list_material`` and ``shingles`` say the same in Python, for all items; tests hold the two against each other. An item of at most
``WIDTH`` words is one shingle, which is its key. Words are told apart by 64 bits of a hash. Letters, digits and lower case are those of the
JVM's Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrosieve.llm.jvm import functions
from ferrosieve.tables import fresh_path

LISTING, SHINGLES = "FerrosieveListing", "FerrosieveShingles"
#: Of list material: keys, characters and repeated pairs of the items, by key and pair; and each key or pair with its shingles.
LISTED = "chars bigint, links bigint, listed bigint, k array<bigint>, n array<int>, p array<bigint>, of array<bigint>, h array<bigint>"
#: Share of the shingles nobody asked for that may pass the filter.
PASSING = 0.02

_SOURCE = r"""
import java.util.Arrays;
import java.util.HashMap;
import java.util.Iterator;
import java.util.Locale;
import java.util.Map;

class FerrosievePage {
    static final int WIDTH = @WIDTH@, SHORT_ITEM = @SHORT_ITEM@, LEAST_RUN = @LEAST_RUN@, LONG_ITEM = @LONG_ITEM@;
    static final double PART = @PART@, PART_LONG = @PART_LONG@, PAGE_PART = @PAGE_PART@, STUFFED = @STUFFED@, STUFFED_LONG = @STUFFED_LONG@;
    static final int LETTERS = 1 << Character.UPPERCASE_LETTER | 1 << Character.LOWERCASE_LETTER | 1 << Character.TITLECASE_LETTER | 1 << Character.MODIFIER_LETTER | 1 << Character.OTHER_LETTER
        | 1 << Character.DECIMAL_DIGIT_NUMBER | 1 << Character.LETTER_NUMBER | 1 << Character.OTHER_NUMBER;
    static final long[] ODD = new long[WIDTH + 1];
    static {
        for (int j = 0; j <= WIDTH; j++) ODD[j] = mixed(j + 1) | 1;
    }

    final int[] text;
    final int length;
    // words of the page in order, by number; number 0 stands for all words with a digit
    int[] ids;
    int words, open, chars;
    // different words: where they begin and end, and their hashes
    int[] from = new int[256], to = new int[256], slots = new int[1024];
    long[] hash = new long[256];
    int different = 1;
    // items: where their words end, characters, whether a link
    int[] ends = new int[64], sizes = new int[64];
    boolean[] link = new boolean[64];
    int items;

    static long mixed(long h) {
        h = (h ^ h >>> 30) * 0xBF58476D1CE4E5B9L;
        h = (h ^ h >>> 27) * 0x94D049BB133111EBL;
        return h ^ h >>> 31;
    }

    static boolean space(int c) {
        if (c <= 32) return c >= 9 && c <= 13 || c >= 28;
        return c >= 0x85 && (c == 0x85 || c == 0xA0 || c == 0x1680 || c >= 0x2000 && c <= 0x200A || c == 0x2028 || c == 0x2029 || c == 0x202F || c == 0x205F || c == 0x3000);
    }

    static boolean cjk(int c) {
        return c >= 0x3040 && (c <= 0x30FF || c >= 0x3400 && c <= 0x9FFF);
    }

    static boolean letter(int c) {
        if (c < 128) return c >= 'a' && c <= 'z' || c >= '0' && c <= '9' || c >= 'A' && c <= 'Z';
        return (LETTERS >> Character.getType(c) & 1) != 0;
    }

    static boolean digit(int c) {
        return c < 128 ? c >= '0' && c <= '9' : Character.getType(c) == Character.DECIMAL_DIGIT_NUMBER;
    }

    FerrosievePage(String s) {
        text = s.toLowerCase(Locale.ROOT).codePoints().toArray();
        length = text.length;
        ids = new int[length / 4 + 16];
        hash[0] = mixed(1);
        int last = -2, i = 0;
        while (i < length) {
            int c = text[i], j = i + 1;
            if (c == 'h' || c == 'w') {
                int e = linked(i);
                if (e > 0) {
                    cut();
                    item(e - i, true);
                    i = e;
                    continue;
                }
            }
            if (cjk(c)) {
                while (j < length && cjk(text[j])) j++;
                if (words > open && i > last) cut();
                for (int k = i; k < j; k += 2) word(k, Math.min(k + 2, j));
                chars += j - i + 1;
                last = j;
            } else if (letter(c)) {
                boolean digits = digit(c);
                for (; j < length && letter(text[j]) && !cjk(text[j]); j++) digits |= digit(text[j]);
                while (j + 1 < length && (text[j] == '-' || text[j] == '\'' || text[j] == 0x2019) && letter(text[j + 1]))
                    for (j++; j < length && letter(text[j]); j++) digits |= digit(text[j]);
                if (digits) add(0);
                else word(i, j);
                chars += j - i + 1;
            } else if (cuts(c, i)) cut();
            i = j;
        }
        cut();
    }

    boolean at(int i, String s) {
        if (i + s.length() > length) return false;
        for (int k = 0; k < s.length(); k++) if (text[i + k] != s.charAt(k)) return false;
        return true;
    }

    int linked(int i) {
        int e = at(i, "http://") ? i + 7 : at(i, "https://") ? i + 8 : at(i, "www.") ? i + 4 : length;
        if (e >= length || space(text[e])) return 0;
        while (e < length && !space(text[e])) e++;
        return e;
    }

    boolean cuts(int c, int i) {
        switch (c) {
            case ',': case ';': case '|': case 0xB7: case 0x2022: case '#': case 0xBB: case '>': case '/': case '\n': case 0x3001: case 0x2026: case 0x3002:
                return true;
            case '.': case '!': case '?': case 0xFF01: case 0xFF1F:
                return i + 1 == length || space(text[i + 1]);
            case '-': case 0x2013: case 0x2014:
                return i > 0 && space(text[i - 1]) && i + 1 < length && space(text[i + 1]);
            default:
                return false;
        }
    }

    void add(int id) {
        if (words == ids.length) ids = Arrays.copyOf(ids, 2 * words);
        ids[words++] = id;
    }

    void word(int a, int b) {
        long h = b - a;
        for (int k = a; k < b; k++) {
            h = (h ^ text[k]) * 0x9E3779B97F4A7C15L;
            h ^= h >>> 32;
        }
        h = mixed(h);
        int s = (int) h & slots.length - 1;
        while (slots[s] > 0 && hash[slots[s]] != h) s = s + 1 & slots.length - 1;
        if (slots[s] == 0) {
            if (different == from.length) {
                from = Arrays.copyOf(from, 2 * different);
                to = Arrays.copyOf(to, 2 * different);
                hash = Arrays.copyOf(hash, 2 * different);
                slots = new int[8 * different];
                for (int w = 1; w < different; w++) {
                    s = (int) hash[w] & slots.length - 1;
                    while (slots[s] > 0) s = s + 1 & slots.length - 1;
                    slots[s] = w;
                }
                s = (int) h & slots.length - 1;
                while (slots[s] > 0) s = s + 1 & slots.length - 1;
            }
            from[different] = a;
            to[different] = b;
            hash[different] = h;
            slots[s] = different++;
        }
        add(slots[s]);
    }

    void cut() {
        if (words > open) {
            item(chars, false);
            chars = 0;
            open = words;
        }
    }

    void item(int size, boolean linked) {
        if (items == ends.length) {
            ends = Arrays.copyOf(ends, 2 * items);
            sizes = Arrays.copyOf(sizes, 2 * items);
            link = Arrays.copyOf(link, 2 * items);
        }
        ends[items] = words;
        sizes[items] = size;
        link[items++] = linked;
    }

    int begin(int item) {
        return item == 0 ? 0 : ends[item - 1];
    }

    long shingle(int a, int width) {
        long h = width * ODD[WIDTH];
        for (int j = 0; j < width; j++) h += hash[ids[a + j]] * ODD[j];
        return h;
    }

    long key(int a, int b) {
        if (b - a <= WIDTH) return shingle(a, b - a);
        long h = b - a;
        for (int k = a; k < b; k++) h = mixed(h * 0x9E3779B97F4A7C15L + hash[ids[k]]);
        return h;
    }

    // put the shingles of the words a to b into out from n on; gives where they end
    int shingles(int a, int b, long[] out, int n) {
        if (b - a <= WIDTH) out[n++] = shingle(a, b - a);
        else for (int k = a; k + WIDTH <= b; k++) out[n++] = shingle(k, WIDTH);
        return n;
    }

    static int distinct(long[] h, int n) {
        Arrays.sort(h, 0, n);
        int m = 0;
        for (int k = 0; k < n; k++) if (k == 0 || h[k] != h[k - 1]) h[m++] = h[k];
        return m;
    }

    // words that some item repeats over and over, and that make up a good part of the page; null if there are none
    boolean[] stuffed() {
        boolean[] repeated = new boolean[different];
        int[] count = new int[different];
        boolean any = false;
        for (int x = 0; x < items; x++) {
            int a = begin(x), b = ends[x], n = b - a, inside = 0;
            if (n <= 5) continue;
            double least = n > LONG_ITEM ? Math.max(4, PART_LONG * n) : Math.max(3, PART * n);
            for (int k = a; k < b; k++) count[ids[k]]++;
            for (int k = a; k < b; k++) if (count[ids[k]] >= least) inside++;
            if (inside > 0 && (n <= LONG_ITEM || inside >= STUFFED_LONG * n))
                for (int k = a; k < b; k++) if (count[ids[k]] >= least) any = repeated[ids[k]] = true;
            for (int k = a; k < b; k++) count[ids[k]] = 0;
        }
        if (!any) return null;
        for (int k = 0; k < words; k++) count[ids[k]]++;
        any = false;
        for (int w = 0; w < different; w++) any |= repeated[w] = repeated[w] && w > 0 && count[w] >= Math.max(4, PAGE_PART * words);
        return any ? repeated : null;
    }

    // whether each item belongs to a run of short ones that is long enough or has a link
    boolean[] runs() {
        boolean[] listed = new boolean[items];
        for (int i = 0, j = 0; i < items; i = Math.max(j, i + 1)) {
            boolean linked = false;
            for (j = i; j < items && ends[j] - begin(j) <= SHORT_ITEM; j++) linked |= link[j];
            if (j - i >= LEAST_RUN || linked && j - i > 1) Arrays.fill(listed, i, j, true);
        }
        return listed;
    }

    int compared(int a, int b) {
        int n = a == 0 ? 1 : to[a] - from[a], m = b == 0 ? 1 : to[b] - from[b];
        for (int k = 0; k < n && k < m; k++) {
            int c = (int) '0', d = (a == 0 ? c : text[from[a] + k]) - (b == 0 ? c : text[from[b] + k]);
            if (d != 0) return d;
        }
        return n - m;
    }

    // shingle of the pair of words that the words a to b repeat most; of several, the last in the order of the words
    long pair(int a, int b) {
        HashMap counts = new HashMap();
        int best = a, most = 0;
        for (int k = a; k + 1 < b; k++) {
            Long of = Long.valueOf((long) ids[k] << 32 | ids[k + 1]);
            int[] c = (int[]) counts.get(of);
            if (c == null) counts.put(of, c = new int[] {0, k});
            c[0]++;
        }
        for (Iterator i = counts.values().iterator(); i.hasNext(); ) {
            int[] c = (int[]) i.next();
            int d = c[0] - most;
            if (d == 0) d = compared(ids[c[1]], ids[best]);
            if (d == 0) d = compared(ids[c[1] + 1], ids[best + 1]);
            if (d > 0) {
                most = c[0];
                best = c[1];
            }
        }
        return shingle(best, 2);
    }
}

public class FerrosieveListing implements org.apache.spark.sql.api.java.UDF1, java.io.Serializable {
    public Object call(Object text) {
        FerrosievePage p = new FerrosievePage(text == null ? "" : (String) text);
        long total = 0, links = 0, own = 0;
        boolean[] stuffed = p.stuffed(), listed = p.runs();
        HashMap place = new HashMap();
        int found = 0, phrases = 0;
        long[] k = new long[16], of = new long[16], h = new long[16];
        int[] n = new int[16];
        Long[] pairs = new Long[16];
        for (int x = 0; x < p.items; x++) {
            total += p.sizes[x];
            if (p.link[x]) {
                links += p.sizes[x];
                continue;
            }
            int a = p.begin(x), b = p.ends[x];
            Long pair = null;
            if (stuffed != null && !listed[x]) {
                int inside = 0;
                for (int i = a; i < b; i++) if (stuffed[p.ids[i]]) inside++;
                if (inside >= (b - a > FerrosievePage.LONG_ITEM ? FerrosievePage.STUFFED_LONG : FerrosievePage.STUFFED) * (b - a)) {
                    listed[x] = true;
                    if (b - a > 5) pair = Long.valueOf(p.pair(a, b));
                }
            }
            if (!listed[x]) continue;
            own += p.sizes[x];
            long key = p.key(a, b);
            Long both = Long.valueOf(pair == null ? key : FerrosievePage.mixed(key + 0x9E3779B97F4A7C15L * pair.longValue()));
            Integer at = (Integer) place.get(both);
            if (at == null) {
                if (found == k.length) {
                    k = Arrays.copyOf(k, 2 * found);
                    n = Arrays.copyOf(n, 2 * found);
                    pairs = (Long[]) Arrays.copyOf(pairs, 2 * found);
                }
                place.put(both, at = Integer.valueOf(found));
                k[found] = key;
                pairs[found++] = pair;
                int room = phrases + b - a + 1;
                if (room > h.length) {
                    h = Arrays.copyOf(h, 2 * room);
                    of = Arrays.copyOf(of, 2 * room);
                }
                int m = p.shingles(a, b, h, phrases);
                Arrays.fill(of, phrases, m, key);
                if (pair != null) of[m] = h[m++] = pair.longValue();
                phrases = m;
            }
            n[at.intValue()] += p.sizes[x];
        }
        return org.apache.spark.sql.RowFactory.create(new Object[] {Long.valueOf(total), Long.valueOf(links), Long.valueOf(own), Arrays.copyOf(k, found), Arrays.copyOf(n, found), Arrays.copyOf(pairs, found), Arrays.copyOf(of, phrases), Arrays.copyOf(h, phrases)});
    }
}

public class FerrosieveShingles implements org.apache.spark.sql.api.java.UDF2, java.io.Serializable {
    static String held;
    static org.apache.spark.util.sketch.BloomFilter asked;

    static synchronized org.apache.spark.util.sketch.BloomFilter asked(String path) throws Exception {
        if (!path.equals(held)) {
            org.apache.hadoop.fs.Path at = new org.apache.hadoop.fs.Path(path);
            java.io.InputStream in = at.getFileSystem(org.apache.spark.deploy.SparkHadoopUtil.get().conf()).open(at);
            try {
                asked = org.apache.spark.util.sketch.BloomFilter.readFrom(new java.io.BufferedInputStream(in));
            } finally {
                in.close();
            }
            held = path;
        }
        return asked;
    }

    public Object call(Object text, Object path) throws Exception {
        if (text == null) return null;
        org.apache.spark.util.sketch.BloomFilter wanted = asked((String) path);
        FerrosievePage p = new FerrosievePage((String) text);
        long[] h = new long[p.words];
        int n = 0, kept = 0;
        for (int x = 0; x < p.items; x++) if (!p.link[x]) n = p.shingles(p.begin(x), p.ends[x], h, n);
        for (int i = 0; i < n; i++) if (wanted.mightContainLong(h[i])) h[kept++] = h[i];
        return kept == 0 ? null : Arrays.copyOf(h, FerrosievePage.distinct(h, kept));
    }
}
"""


def _functions(spark: SparkSession) -> None:
    from ferrosieve.llm import p10_stuffing as rules

    source = _SOURCE
    for name in ("WIDTH", "SHORT_ITEM", "LEAST_RUN", "LONG_ITEM", "PART", "PART_LONG", "PAGE_PART", "STUFFED", "STUFFED_LONG"):
        source = source.replace(f"@{name}@", repr(getattr(rules, name)))
    functions(spark, source, {LISTING: (1, f"struct<{LISTED.replace(' ', ':').replace(',:', ',')}>"), SHINGLES: (2, "array<bigint>")})


def listing(spark: SparkSession, text: Column) -> Column:
    """A struct ``LISTED`` of a page."""
    _functions(spark)
    return F.call_function(LISTING, text)


def asked_file(hashes: DataFrame, column: str, n: int) -> str:
    """A file in the shared folder with a Bloom filter of the ``n`` rows of a column; Spark bounds it to 8 MB, above some millions of rows more passes it."""
    spark = hashes.sparkSession
    held = hashes._jdf.stat().bloomFilter(column, n, PASSING) if n else spark.sparkContext._jvm.org.apache.spark.util.sketch.BloomFilter.create(1)
    path = fresh_path(spark, "p10-asked")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    try:
        held.writeTo(out)
    finally:
        out.close()
    return path


def shingles(spark: SparkSession, text: Column, asked: str) -> Column:
    """The distinct shingles of all items of a page that pass the filter in the file ``asked``; null if none does."""
    _functions(spark)
    return F.call_function(SHINGLES, text, F.lit(asked))
