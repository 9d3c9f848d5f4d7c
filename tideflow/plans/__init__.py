"""How ordered operators become distributed plans."""
