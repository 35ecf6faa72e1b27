import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "Word number " + " ".join(f"w{i % 977}x{i % 13}," for i in range(9000))
ODD = [
    None, "", " ", "\n\t", "one", "One two", "ONE two three four", "a b c d e", "a b c d e", "A B C D E f g", "İstanbul ẞtraße é é ﬁ", " nbsp em \u0085nel",
    "x  y   z \n\n q ", "'s it's I'LL don't", "<|endoftext|> in <|endoftext|>text<|startoftext|>", "日本語のテキスト 漢字", "emoji 😀😀 ok", "1 22 333 4,444.5", "tab\tsep\x0b\x0c\r\nend", "\x00nul \x1funit",
    LONG, LONG + " tail", LONG[:-700], "z" * 40000, " " * 3000 + "end", "the loser is a pathetic idiot and a moron",
]




@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    """Tables with nulls, blank, odd and very long texts, ties, and columns whose names clash."""
    d = tmp_path_factory.mktemp("odd")
    ids = list(range(len(ODD)))
    ids[3], ids[8] = None, ids[7]  # a null id; a row repeated whole
    docs = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(ODD, pa.string()), "lang": pa.array([None if i % 7 == 0 else ["en", "de"][i % 2] for i in range(len(ODD))], pa.string()),
        "source": pa.array([None if i % 5 == 0 else "hot" for i in range(len(ODD))], pa.string()), "n_chars": pa.array([len(x or "") for x in ODD], pa.int64()),
    }
    docs |= {c: pa.array(["clash"] * len(ODD)) for c in ("fp", "node", "score", "tokens", "topic", "token", "ids", "slot", "shard", "own", "to", "root", "n_tokens", "factor", "item_id", "row")}
    pq.write_table(pa.table(docs), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0, 1, 2, None, 25, 24, 7, 9], pa.int64()), "quality": pa.array([1] * 8, pa.int32()), "toxic": pa.array([0, 0, None, 1, 1, 0, 0, 0], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3, None, 5], pa.int64()), "text": pa.array([None, " ", LONG[200:420], "four words of text", "a b c d e"], pa.string())}), d / "benchmark.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), d / "benchmark.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), d / "pages.parquet")
    return str(d)


def documents(directory):
    import glob

    t = pq.read_table(f"{directory}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
