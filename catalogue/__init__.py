"""The queries the library answers on the trade tables, and equivalent SQL to check them."""
