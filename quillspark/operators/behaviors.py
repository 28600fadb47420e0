"""Behaviour tokens: what a text does, named alike in every language, as one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.needles import is_likely, likely

#: Tokens and their patterns, without case; DOTALL only where it says so.
TOKENS = {
    "__bt_process_exec__": r"(?:\b(?:invoke-expression|iex|start-process|cmd(?:\.exe)?|powershell(?:\.exe)?|createprocess(?:a|w)?|winexec|shellexecute|system|popen|execve|os/exec|exec\.command|command::new|std::process::command)\b)",
    "__bt_download__": r"(?:\b(?:downloadfile|downloadstring|invoke-webrequest|iwr|wget|curl|urlmon|urldownloadtofile|webclient|http\.get|client\.do)\b|https?://)",
    "__bt_network__": r"\b(?:tcpclient|udpclient|socket|connect|net/http|http\.newrequest|tcpstream|tcplistener|reqwest|tokio::net|websocket|reverse.?shell)\b",
    "__bt_persistence__": r"(?:currentversion[\\/]+run|\b(?:register-scheduledtask|schtasks|new-service|createservice|startup|launchagent|crontab|systemd|autorun|set-itemproperty)\b)",
    "__bt_injection__": r"\b(?:virtualalloc(?:ex)?|writeprocessmemory|createremotethread|ntwritevirtualmemory|queueuserapc|rtlmovememory|openprocess|process.?hollow|reflective.?load|ptrace|process_vm_writev)\b",
    "__bt_security_bypass__": r"\b(?:add-mppreference|set-mppreference|amsi(?:utils|initfailed)?|disableantispyware|exclusionpath|etwpatch|bypassuac|uac.?bypass|executionpolicy\s+bypass)\b",
    "__bt_shellcode__": r"(?s)(?:\bshellcode\b|\[\s*byte\s*\[\s*\]\s*\].{0,200}(?:0x[0-9a-f]{1,2}\s*,\s*){8,}|(?:0x[0-9a-f]{1,2}\s*,\s*){16,})",
    "__bt_credentials__": r"\b(?:login data|local state|dpapi|cryptunprotectdata|credential|password|passwd|browser.?cookie|discord.?token|wallet|seed phrase|keylog(?:ger)?)\b",
    "__bt_crypto_destructive__": r"\b(?:ransom|encryptfile|decryptfile|deletefile|remove-item|unlink|wipe|shred|shadowcopy|vssadmin|cipher::new|aes256|chacha20)\b",
    "__bt_obfuscation__": r"\b(?:frombase64string|base64decode|invoke-obfuscation|encodedcommand|charcode|fromcharcode|gzipstream|deflatestream|xor.?decode|assembly\.load)\b",
    "__bt_capture__": r"\b(?:copyfromscreen|screenshot|system\.windows\.forms\.screen|getasynckeystate|setwindowshookex|clipboard)\b",
    "__bt_antianalysis__": r"\b(?:isdebuggerpresent|checkremotedebuggerpresent|ntqueryinformationprocess|virtualbox|vmware|sandbox|anti.?vm|anti.?debug)\b",
}
#: Tokens of PowerShell alone, and those that version 3 adds.
POWERSHELL = {
    "__bt_ps_linter_settings__": r"(?:psscriptanalyzer|includerules|excluderules|psuseapprovedverbs|psavoidusing)",
    "__bt_ps_signed_linter_settings__": r"(?s)(?:psscriptanalyzer|includerules|excluderules).{0,20000}#\s*sig\s*#\s*begin signature block",
    "__bt_ps_module_manifest__": r"(?:rootmodule|moduleversion|functionstoexport|cmdletstoexport|requiredmodules)",
    "__bt_localization_resource__": r"(?:convertfrom-stringdata|localizeddata|strings\.psd1|cultureinfo|localizations?[\\/])",
}
VERSION_3 = {
    "__bt_privilege_escalation__": r"\b(?:bypassuac|uac.?bypass|elevat(?:e|ed|ion)|fodhelper|computerdefaults|sdclt|token.?elevation|sedebugprivilege)\b",
    "__bt_dynamic_winapi__": r"\b(?:newlazydll|newproc|getprocaddress|loadlibrary(?:a|w)?|getmodulehandle(?:a|w)?)\b",
    "__bt_memory_execution__": r"\b(?:virtualprotect|virtualalloc(?:ex)?|page_execute(?:_readwrite)?|writeprocessmemory|createremotethread)\b",
    "__bt_wifi_credentials__": r"\b(?:wlangetprofile|wlan_profile_get_plaintext_key|wlanprofile|wireless.?password|wifi.?password)\b",
    "__bt_self_delete__": r"\b(?:filedispositioninfo|filerenameinfo|movefileex(?:a|w)?|deletefile(?:a|w)?|self.?delete|self.?erase)\b",
}
#: Further patterns of two tokens in version 3.
ALSO = {"__bt_network__": r"\b(?:tcpsocket|tcpserver|udpsocket)\b", "__bt_process_exec__": r"\b(?:open3|io\.popen|kernel\.exec)\b"}
#: A chain stands where both of its tokens do.
CHAINS = {
    "__bt_chain_download_exec__": ("__bt_download__", "__bt_process_exec__"), "__bt_chain_network_exec__": ("__bt_network__", "__bt_process_exec__"),
    "__bt_chain_bypass_download__": ("__bt_security_bypass__", "__bt_download__"), "__bt_chain_injection_shellcode__": ("__bt_injection__", "__bt_shellcode__"),
}
#: The two that need download or injection stay with the tokens of version 1, whose patterns version 3 doesn't widen.
CHAINS_3 = {
    "__bt_chain_network_exec__": ("__bt_network__", "__bt_process_exec__"), "__bt_chain_dynamic_memory_exec__": ("__bt_dynamic_winapi__", "__bt_memory_execution__"),
    "__bt_chain_credential_network__": ("__bt_network__", "__bt_credentials__"), "__bt_chain_wifi_credential_network__": ("__bt_network__", "__bt_wifi_credentials__"),
}


def _folded(pattern: str) -> str:
    """The pattern without case, with its flags in one place."""
    return "(?is)" + pattern[4:] if pattern.startswith("(?s)") else f"(?i){pattern}"


def _named(text: Column, table: dict[str, str]) -> Column:
    may = likely(text, [_folded(p) for p in table.values()])
    return F.array_compact(F.array(*[F.when(is_likely(may, k) & text.rlike(f"(?iU){p}"), F.lit(t)) for k, (t, p) in enumerate(table.items())]))


def _chained(tokens: Column, chains: dict[str, tuple[str, str]]) -> Column:
    """Both ends from the tokens alone: chains don't feed chains."""
    both = [F.when(reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in pair]), F.lit(name)) for name, pair in chains.items()]
    return F.array_union(tokens, F.array_compact(F.array(*both)))


def behavior_tokens(text: Column, language: Column, version: int = 1) -> Column:
    """The tokens of a text, each once, sorted; none for a null text; a null language is none."""
    text = F.coalesce(text, F.lit(""))
    shell = F.coalesce(F.lower(language) == "powershell", F.lit(False))
    tokens = F.concat(_named(text, TOKENS), F.when(shell, _named(text, POWERSHELL)).otherwise(F.array().cast("array<string>")))
    tokens = F.transform(F.array(tokens), lambda x: _chained(x, CHAINS)).getItem(0)
    if version >= 3:
        more = F.array_union(F.array_union(tokens, _named(text, VERSION_3)), _named(F.lower(text), ALSO))
        tokens = F.transform(F.array(more), lambda x: _chained(x, CHAINS_3)).getItem(0)
    return F.array_sort(tokens)


def token_text(text: Column, language: Column, version: int = 1) -> Column:
    """The text with its tokens on a line of their own: once in version 1, four times (those of 1) in 2 and (those of 3) in 3; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    tokens = behavior_tokens(text, language, version)
    told = F.array_join(F.flatten(F.array_repeat(tokens, 1 if version == 1 else 4)), " ")
    return F.when(told == "", text).otherwise(F.concat(text, F.lit("\n"), told))
