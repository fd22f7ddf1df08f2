"""Reading and writing of pair tables, word lists, feature stores and predictions."""
